"""Appends that are committed: once per batch, in one order, with ids that no later append uses again.

The commits of a table, or of one part of it (`scope`), are small numbered files below `<root>/_commits`.
Creating the next number is the commit, and only one writer can create it, so rows that were computed from
an older state are never added. A commit names the batch (`token`), the highest id of its rows (`high`) and
the folder they were written to (`pending`).

Rows are written to the pending folder first. After the commit their files move into the table; whoever finds
files of the last commit still pending moves them before going on. So a load that broke off before the commit
has added nothing, and one that broke off after it is completed by the next.

Ids need no look at the table: numbered files below `<root>/_ids/<table>` tell how far they were given out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tradewind.operators.joins import new_rows
from tradewind.operators.keys import assign_ids
from tradewind.sinks.tables import conform, write_rows
from tradewind.sources import storage
from tradewind.sources.tables import read_table, table_path

MOVERS = 16
TRIES = 20
COMMIT = "number bigint, token string, high bigint, rows bigint, pending string"


@dataclass(frozen=True)
class Commit:
    number: int
    token: str | None
    high: int
    rows: int
    pending: str | None


def take_ids(spark: SparkSession, root: str, name: str, id_col: str, count: int) -> int:
    """Give out a number of ids that no other append gets; returns the id before the first.

    Only a table that never gave out ids this way is searched for its highest one.
    """
    folder = f"{root.rstrip('/')}/_ids/{name}"
    for _ in range(TRIES):
        number, text = storage.last_numbered(spark, folder)
        if text:
            high = int(text)
        else:
            high = read_table(spark, name, root).agg(F.coalesce(F.greatest(F.max(id_col), F.lit(0)), F.lit(0))).first()[0]
        if storage.create_numbered(spark, folder, number + 1, str(high + count)):
            return high
    raise RuntimeError(f"too many writers take ids of {name}")


class Ledger:
    """The commits of a table below a warehouse root, or of one part of it that is written on its own."""

    def __init__(self, spark: SparkSession, root: str, name: str, scope: object = None, schema: StructType | None = None) -> None:
        self.spark, self.root, self.name, self.schema = spark, root.rstrip("/"), name, schema
        self.folder = f"{self.root}/_commits/{name}" + ("" if scope is None else f"-{scope}")

    def last(self) -> Commit | None:
        """The last commit; the number of a lost writer counts as a commit of nothing."""
        number, text = storage.last_numbered(self.spark, self.folder)
        return replace(Commit(**json.loads(text)), number=number) if text else None

    def has(self, token: str) -> bool:
        """Whether a batch was committed; the commits are read as a table."""
        if not storage.names(self.spark, self.folder):
            return False
        return not self.spark.read.schema(COMMIT).json(self.folder).where(F.col("token") == token).isEmpty()

    def commit(self, after: Commit | None, token: str | None, high: int, rows: int, pending: str | None) -> Commit | None:
        """The commit that follows another one; None when somebody else has made it."""
        commit = Commit(after.number + 1 if after else storage.last_numbered(self.spark, self.folder)[0] + 1, token, high, rows, pending)
        if after is None and commit.number > 1 and self.last():
            return None
        return commit if storage.create_numbered(self.spark, self.folder, commit.number, json.dumps(asdict(commit))) else None

    def publish(self, commit: Commit | None) -> None:
        """Move the files of a commit into the table; files that are there already were moved before."""
        if commit is None or commit.pending is None:
            return
        target = table_path(self.spark, self.name, self.root)

        def move(file: str) -> None:
            storage.make_dirs(self.spark, f"{target}/{file}".rpartition("/")[0])
            moved = storage.try_rename(self.spark, f"{commit.pending}/{file}", f"{target}/{file}")
            if not moved and not storage.exists(self.spark, f"{target}/{file}"):
                raise OSError(f"{file} of commit {commit.number} of {self.name} is lost")

        files = storage.files_below(self.spark, commit.pending)
        files = [file for file in files if not file.rpartition("/")[2].startswith((".", "_"))]
        if files:
            with ThreadPoolExecutor(MOVERS) as pool:
                list(pool.map(move, files))
        storage.remove(self.spark, commit.pending)

    def settled(self) -> Commit | None:
        """The last commit, with its rows in the table."""
        last = self.last()
        self.publish(last)
        return last

    def add(
        self,
        find: Callable[[DataFrame], DataFrame],
        id_col: str | None = None,
        keys: Sequence[str] = (),
        finish: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
        token: str | None = None,
    ) -> int:
        """Append the rows that `find` gives for the table as it stands; returns their number.

        When another writer commits in between, the rows are found again. Rows get ids in the order of their
        keys; `finish` may complete numbered rows. A batch whose token was committed adds nothing. `find` should
        give staged rows, because they are counted, numbered and written.
        """
        if token is not None and self.has(token):
            self.settled()
            return 0
        for _ in range(TRIES):
            last = self.settled()
            table = read_table(self.spark, self.name, self.root, self.schema)
            rows = find(table)
            count = rows.count()
            if not count and token is None:
                return 0
            high = last.high if last else 0
            if id_col is not None and count:
                first = take_ids(self.spark, self.root, self.name, id_col, count)
                rows, high = assign_ids(rows, id_col, list(keys), start=first), first + count
            pending = f"{self.root}/_pending/{self.name}-{uuid.uuid4().hex}"
            write_rows(conform(finish(rows, table) if finish else rows, self.name), self.name, pending, self.root)
            commit = self.commit(last, token, high, count, pending)
            if commit:
                self.publish(commit)
                return count
            storage.remove(self.spark, pending)
        raise RuntimeError(f"too many writers of {self.name}")


def insert_if_absent(rows: DataFrame, name: str, root: str, keys: list[str], token: str | None = None) -> int:
    """Append the rows whose key the table lacks; returns their number.

    Two writers never add the same key: the one that commits second looks again. A null key is always new.
    """
    return Ledger(rows.sparkSession, root, name, schema=rows.schema).add(lambda table: new_rows(rows, table, keys), token=token)
