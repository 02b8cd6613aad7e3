"""Secrets in texts: certain ones by form, weak ones by the company they keep.

Three kinds are reported wherever they match: `assign`, `access` and `hex`. Two kinds are weak, because
clean texts hold such strings too: `id`, an account name after a key word, and `mixed`, a long string with
digits, capitals and small letters. Credentials come in parts: an access identifier, a secret, an
endpoint. A weak candidate is reported only if a complementary part that does not overlap it lies in its
scope, that is, begins or ends within `scope` code points of it: for `id` a secret, for `mixed` an
identifier or an endpoint. Weak candidates that overlap a certain one are left out, and `mixed` ones inside
an account name or an endpoint, which are a part of it; endpoints alone are never reported.

All parts of a text become rows with their interval. The interval join of weak candidates with
complementary parts is a sweep along the borders of parts: the largest end up to the beginning and the
smallest beginning from the end of each candidate are running extremes, so no pairs are formed and a text with many parts stays linear. Texts
stay where they were read; only parts are shuffled, once, by the number of their row.

A null text is an empty one, without spans. Rows that repeat are scanned one by one. Spans are code
points with exclusive ends. Extra columns are not read. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 200

# What the three certain kinds match, and the least length of what the last column names.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

ACCOUNT = r"""(?i)(user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
LEAST_ACCOUNT = 3
MIXED = r"[A-Za-z0-9+/_-]{16,}={0,2}"
ENDPOINT = r"""(?i)https?://[^\x20\x09-\x0D"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+"""

#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "id", "mixed", "endpoint")
CERTAIN = 3


def _matches(number: int, pattern: str, group: int, fits: Callable[[Column, Column], Column]) -> Column:
    """Every match of one kind with the gap before it; `fits` sees the match and one of its groups."""
    text, form = F.col("_text"), F.lit(pattern)
    found = F.zip_with(
        F.regexp_extract_all(text, form, F.lit(0)),
        F.regexp_extract_all(text, form, F.lit(group)),
        lambda hit, value: F.struct(hit.alias("hit"), value.alias("value")),
    )
    with_gaps = F.zip_with(F.split(text, form, -1), found, lambda gap, m: F.struct(gap.alias("gap"), m["hit"].alias("hit"), m["value"].alias("value")))
    return F.transform(
        F.filter(with_gaps, lambda m: m["hit"].isNotNull()),
        lambda m, place: F.struct(
            F.lit(number).alias("kind"),
            place.alias("place"),
            F.length(m["gap"]).alias("gap"),
            F.length(m["hit"]).alias("size"),
            fits(m["hit"], m["value"]).alias("fits"),
        ),
    )


def _parts() -> Column:
    def always(hit: Column, value: Column) -> Column:
        return F.lit(True)

    def varied(hit: Column, value: Column) -> Column:
        return hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]")

    return F.concat(
        _matches(0, ASSIGN, 2, lambda hit, value: F.length(value) >= LEAST_ASSIGNED),
        _matches(1, ACCESS.replace("+", f"{{{LEAST_ACCESS - 4},}}"), 0, always),
        _matches(2, HEX.replace("+", f"{{{LEAST_HEX},}}"), 0, always),
        _matches(3, ACCOUNT, 2, lambda hit, value: F.length(value) >= LEAST_ACCOUNT),
        _matches(4, MIXED, 0, varied),
        _matches(5, ENDPOINT, 0, always),
    )


def parts(docs: DataFrame) -> DataFrame:
    """One row per match with its interval; the kind is null where the match does not count or there is none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("_text"))
    found = rows.select("_row", "doc_id", F.explode_outer(_parts()).alias("_part")).select("_row", "doc_id", "_part.*")
    run = Window.partitionBy("_row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(run)
    return found.repartition("_row").withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).withColumn("kind", F.when(F.col("fits"), F.col("kind")))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Parts with the kind kept for certain ones and for weak ones with a complementary part in scope."""
    by_start = Window.partitionBy("_row").orderBy("start", "kind")
    before, after = by_start.rowsBetween(Window.unboundedPreceding, -1), by_start.rowsBetween(1, Window.unboundedFollowing)
    certain = F.col("kind") < CERTAIN
    hidden = (F.max(F.when(certain, F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(certain, F.col("start"))).over(after) < F.col("end"))
    hidden = F.coalesce(hidden, F.lit(False)) & ~certain & (F.col("kind") < KINDS.index("endpoint"))
    free = found.withColumn("_hidden", hidden).withColumn("kind", F.when(~F.col("_hidden"), F.col("kind")))

    held = F.max(F.when(F.col("kind").isin(KINDS.index("id"), KINDS.index("endpoint")), F.col("end")))
    up_to = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.coalesce((F.col("kind") == KINDS.index("mixed")) & (held.over(up_to) >= F.col("end")), F.lit(False))
    free = free.withColumn("_inside", inside).withColumn("kind", F.when(~F.col("_inside"), F.col("kind")))
    borders = F.array(*[F.struct(F.col(name).alias("at"), F.lit(name == "end").alias("is_end")) for name in ("start", "end")])
    events = free.select("_row", "doc_id", "kind", "start", "end", F.explode(borders).alias("_border")).select("*", "_border.*")
    left = Window.partitionBy("_row").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    right = Window.partitionBy("_row").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)

    def near(kinds: tuple[str, ...]) -> Column:
        of = F.col("kind").isin(*[KINDS.index(kind) for kind in kinds])
        last = F.max(F.when(of & F.col("is_end"), F.col("at"))).over(left)
        following = F.min(F.when(of & ~F.col("is_end"), F.col("at"))).over(right)
        return F.coalesce(F.when(F.col("is_end"), following <= F.col("end") + scope).otherwise(last >= F.col("start") - scope), F.lit(False))

    events = events.withColumn("_secret", near(("assign", "hex", "mixed"))).withColumn("_identity", near(("access", "id", "endpoint")))
    whole = events.groupBy("_row", "kind", "start", "end").agg(F.first("doc_id").alias("doc_id"), *[F.max(name).alias(name) for name in ("_secret", "_identity")])
    weak = F.when(F.col("kind") == 3, F.col("_secret")).when(F.col("kind") == 4, F.col("_identity")).when(F.col("kind") == 5, F.lit(False))
    return whole.withColumn("_shown", F.coalesce(weak, F.lit(True))).withColumn("kind", F.when(F.col("_shown"), F.col("kind")))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: counts of the certain kinds, a digest of their spans, and all spans."""
    named = F.element_at(F.array(*[F.lit(kind) for kind in KINDS]), F.col("kind") + 1)
    shown = linked(parts(docs), scope).withColumn("_span", F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end", named.alias("name"))))
    listed = shown.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        *[F.count_if(F.col("kind") == number).alias(f"n_{KINDS[number]}") for number in range(CERTAIN)],
        F.count_if(F.col("kind") >= CERTAIN).alias("n_linked"),
        F.sort_array(F.collect_list("_span")).alias("_spans"),
    )

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = joined(F.filter("_spans", lambda s: s["kind"] < CERTAIN))
    return listed.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"), "n_linked")
