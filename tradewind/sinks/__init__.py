"""Writers of landing files and warehouse tables."""
