"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns find emails, IPv4 addresses, card and phone numbers; they are the seeds. Every run of tokens with a
digit or an @ is an instance, and the words around it are its contexts: the word before, the two words before, and
the words on either side. Contexts and instances form a graph, with one edge for each distinct pair. In rounds, a
context's score for a kind is the mean score of its distinct instances, if enough seeds support it; an instance that is
no seed takes the best score of its contexts, if its digits can be of that kind. Instances that reach `accept` in
a context that does are reported as further spans. Seeds of one kind count against all others.

Positions come from splitting the text by the same pattern: a match starts where the pieces and matches before it end.
The patterns are written so that they cannot backtrack: possessive, and starting only where a run of their characters
starts or the last match ended. They match the same spans as their plain forms.

Edges are aggregated by pair before they are shuffled, scores are attached through a salted lookup, so a context or
an identifier that occurs everywhere is split over all partitions.

Defined results: null texts are empty; without spans, `spans` is empty and base_sha256 that of an empty text.
Repeated rows get equal results. Null ids take part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import attach, stored

KINDS = ("email", "ip", "card", "phone")

# The base patterns, in a form without backtracking.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
GATES = {"email": "@", "phone": "+"}
SPACE = r"\x20\x09-\x0D"
#: Instances: consecutive tokens, each with a digit or an @.
TOKEN = rf"[^0-9@{SPACE}]*+[0-9@][^{SPACE}]*+"
INSTANCE = rf"(?<![^{SPACE}]){TOKEN}(?:\x20{TOKEN})*+"
PART = 512


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of `value` pass the Luhn check."""
    number = F.reverse(digits(value))
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(number)),
        lambda i: F.when(i % 2 == 1, F.substring(number, i, F.lit(1)).cast("int")).otherwise(
            F.substring(number, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(number, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    size = F.length(digits(value))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)),
        "card": F.when(size.between(12, 19), luhn(value)).otherwise(False),
        "phone": size.between(9, 15),
    }[kind]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of `value`, which is computed once however often `use` reads it, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(sizes: Column) -> Column:
    """Sum of all entries before each entry; built in parts, so that appending stays linear."""

    def append(total: Column, x: Column) -> Column:
        return F.concat(total, F.array(F.element_at(total, -1) + x))

    def by_parts(all_sizes: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_sizes) / PART)).cast("int"))
        parts = F.transform(numbers, lambda c: F.slice(all_sizes, c * PART + 1, PART))
        return let(parts, from_parts)

    def from_parts(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x))
        starts = F.aggregate(sums, F.array(F.lit(0)), append)
        within = F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), lambda p, start: F.slice(F.aggregate(p, F.array(start), append), F.lit(1), F.size(p)))
        return F.flatten(within)

    return let(sizes, by_parts)


def places(df: DataFrame, name: str, pattern: str, gate: Column) -> DataFrame:
    """`df` with column `name`: (start, end, value) of every match in `text`, in code points, and the pieces between
    matches as `name`_gaps. Texts behind the gate only."""
    found, gaps = F.col(f"{name}_found"), F.col(f"{name}_gaps")
    df = df.withColumn(f"{name}_found", F.when(gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn(f"{name}_gaps", F.when(F.size(found) > 0, F.split("text", pattern, -1)))

    def spans(matches: Column) -> Column:
        return let(gaps, lambda pieces: between(matches, pieces))

    def between(matches: Column, pieces: Column) -> Column:
        sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
        return let(running(sizes), lambda sums: F.transform(matches, lambda m, i: span(m, F.element_at(sums, i + 1) + F.length(F.element_at(pieces, i + 1)))))

    def span(match: Column, start: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), (start + F.length(match)).cast("long").alias("end"), match.alias("value"))

    return df.withColumn(name, F.when(F.size(found) > 0, let(found, spans))).drop(f"{name}_found")


SPAN = "array<struct<start: bigint, rank: int, end: bigint, kind: string, value: string>>"
NONE = f"cast(array() as {SPAN})"


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row's content), base (spans by start, then kind), instances with their contexts."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("key", F.xxhash64("text"))
    numeric = F.col("text").rlike("[0-9]")
    for rank, kind in enumerate(KINDS):
        gate = F.contains(F.col("text"), F.lit(GATES[kind])) if kind in GATES else numeric
        df = places(df, kind, PATTERNS[kind], gate).drop(f"{kind}_gaps")
        tagged = F.transform(
            F.filter(kind, lambda s: valid(kind, s.value)),
            lambda s: F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), s.end.alias("end"), F.lit(kind).alias("kind"), s.value.alias("value")),
        )
        df = df.withColumn(kind, F.coalesce(tagged.cast(SPAN), F.expr(NONE)))
    df = df.withColumn("base", F.array_sort(F.concat(*KINDS))).drop(*KINDS)
    df = places(df, "instance", INSTANCE, numeric | F.contains(F.col("text"), F.lit("@")))
    gap = lambda i: F.element_at("instance_gaps", i)
    # The gap is read backwards, so that its last words are found from its start, however long it is.
    before = lambda i, n: F.lower(F.reverse(F.regexp_extract(F.reverse(gap(i)), rf"^((?:[{SPACE}]++[^{SPACE}]++){{{n}}})", 1)))
    after = lambda i: F.lower(F.regexp_extract(gap(i), rf"^[{SPACE}]++([^{SPACE}]++)", 1))
    contexts = F.transform(
        "instance",
        lambda s, i: F.struct(
            s.start.alias("start"),
            s.end.alias("end"),
            F.lower(F.regexp_replace(s.value, r"[.,;:!?)\]}\x22']+$", "")).alias("value"),
            F.length(F.regexp_replace(s.value, r"[.,;:!?)\]}\x22']+$", "")).alias("size"),
            F.array(
                F.concat(F.lit("1 "), before(i + 1, 1)),
                F.concat(F.lit("2 "), before(i + 1, 2)),
                F.concat(F.lit("3 "), before(i + 1, 1), F.lit("| "), after(i + 2)),
            ).alias("contexts"),
        ),
    )
    return df.select("doc_id", "key", "base", contexts.alias("instances"))


def occurrences(rows: DataFrame) -> DataFrame:
    """One row per instance: where it is, its value, its contexts, and the kind of the first seed that it meets."""
    each = rows.select("doc_id", "key", "base", F.explode("instances").alias("i"))
    met = F.filter("base", lambda b: (b.start < F.col("i.end")) & (b.end > F.col("i.start")))
    return each.select(
        "doc_id",
        "key",
        F.col("i.start").alias("start"),
        (F.col("i.start") + F.col("i.size")).alias("end"),
        F.col("i.value").alias("value"),
        F.filter("i.contexts", lambda c: ~c.rlike(r"^(?:[123] |3 \| .*)$")).alias("contexts"),
        F.get(met, F.lit(0)).kind.alias("seed"),
    )


def fits(kind: str, value: Column) -> Column:
    """Whether an instance that no base pattern knows could be of `kind`, by its characters."""
    size = F.length(digits(value))
    return {
        "email": value.rlike(r"^[^@]+@[^@]+$"),
        "ip": value.rlike(r"^[0-9a-f]{1,4}(?:[.:][0-9a-f]{0,4}){3,7}$"),
        "card": value.rlike(r"^[0-9][0-9 -]*$") & size.between(12, 19),
        "phone": value.rlike(r"^[(0-9][0-9 ().-]*$") & size.between(7, 15),
    }[kind]


def discovered(found: DataFrame, rounds: int, support: int, accept: float) -> DataFrame:
    """(doc_id, key, start, rank, end, kind, value) of the spans that contexts give, beyond the seeds."""
    edges = stored(
        found.select("value", F.explode("contexts").alias("context"), *[(F.col("seed") == k).cast("int").alias(k) for k in KINDS])
        .groupBy("context", "value")
        .agg(*[F.coalesce(F.max(k), F.lit(0)).cast("double").alias(k) for k in KINDS])
    )
    known = edges.groupBy("value").agg(*[F.max(k).alias(k) for k in KINDS])
    seeded = reduce(lambda a, b: a + b, [F.col(k) for k in KINDS]) > 0
    scores = known.where(seeded)
    contexts = None
    for _ in range(rounds):
        # Contexts: the mean score of their distinct instances; those that no seeds support are left out.
        linked = attach(edges.select("context", "value"), scores, ["value"], F.col("context"), "left")
        contexts = (
            linked.groupBy("context")
            .agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in KINDS])
            .where(F.greatest(*KINDS) >= support)
            .select("context", *[F.when(F.col(k) >= support, F.col(k) / F.col("n")).otherwise(0.0).alias(k) for k in KINDS])
            .where(F.greatest(*KINDS) >= accept)
        )
        contexts = stored(contexts)
        # Instances: seeds keep their kind; others take the best score of a context that fits them.
        reached = attach(edges.select("context", "value"), contexts, ["context"], F.col("value"))
        reached = reached.groupBy("value").agg(*[F.max(k).alias(k) for k in KINDS]).select("value", *[F.when(fits(k, F.col("value")), F.col(k)).otherwise(0.0).alias(k) for k in KINDS])
        fresh = reached.join(scores.where(seeded & (F.greatest(*KINDS) >= 1)).select("value"), "value", "left_anti")
        scores = stored(known.where(seeded).unionByName(fresh.where(F.greatest(*KINDS) > 0)))
    loose = found.where("seed IS NULL").select("doc_id", "key", "start", "end", "value", F.explode("contexts").alias("context"))
    hit = attach(loose, contexts, ["context"], F.struct("doc_id", "start"))
    kinds = F.array(*[F.struct(F.when(fits(k, F.col("value")), F.col(k)).otherwise(0.0).alias("score"), F.lit(-r).alias("order")) for r, k in enumerate(KINDS)])
    best = hit.withColumn("best", F.array_max(kinds)).where(F.col("best.score") >= accept)
    rank = -F.col("best.order")
    return best.select("doc_id", "key", "start", rank.alias("rank"), "end", F.get(F.array(*map(F.lit, KINDS)), rank).alias("kind"), "value").distinct()


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def counted(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")


def find_pii(docs: DataFrame, rounds: int = 3, support: int = 5, accept: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all), found (as structs)."""
    rows = stored(with_base(docs))
    more = discovered(occurrences(rows), rounds, support, accept)
    one = F.struct("start", F.col("rank").cast("int").alias("rank"), "end", "kind", "value")
    more = more.groupBy("doc_id", "key").agg(F.collect_set(one).alias("more")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "more")
    both = rows.join(more, rows.doc_id.eqNullSafe(F.col("__id")) & (rows.key == F.col("__key")), "left")
    both = both.withColumn("found", F.array_sort(F.concat("base", F.coalesce(F.col("more").cast(SPAN), F.expr(NONE)))))
    return both.select(
        "doc_id",
        *[counted(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        "found",
    )
