"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every text is addressed by the SHA-256 of its content. The ledger, a
Parquet folder, holds one row for each blob and rule version that was ever scanned, with the
spans it found, none included. A scan reads the ids and hashes, takes the blobs for which a
rule version is missing, reads one copy of each such text, applies the missing rules and
appends to the ledger; its findings are then joined back to all rows that hold the blob.
Blobs are grouped by hash alone, so a text with many copies is one row of the ledger.

A rule's spans come from its matches and the pieces between them, whose lengths in code
points add up to the positions. Matches are leftmost and do not overlap within a rule; those
with too short a value are dropped after matching.

Defined results: null text is the empty blob; repeated rows each get their blob's findings;
an empty table writes an empty ledger part; extra columns are kept by ``redact`` and not
read by ``scan``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gullwatch.llm.common import kept_table


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int
    least: int  # code points of the group

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


# The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
#: Kinds beside the base: private key headers and tokens with a known prefix.
ADDED = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("prefixed_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
RULES = BASE + ADDED

#: Entries of an array that are gone through one by one.
TILE = 128

_LEDGER = "blob binary, rule string, version int, spans array<struct<start:int,stop:int>>"
_SPAN = "array<struct<start:int,stop:int>>"


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _tiles(n: Column) -> Column:
    """0, 1, ... for every ``TILE`` of n entries."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(n / TILE).cast("int"), F.lit(1)) - 1)


def _tile(values: Column, k: Column) -> Column:
    return F.slice(values, k * TILE + 1, F.lit(TILE))


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule in a text; an empty array without looking further where nothing matches.

    Positions add up in tiles: first the lengths of whole tiles, then the entries of each
    from where it starts, so that no array grows entry by entry.
    """
    pattern = F.lit(rule.pattern)
    pieces = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("whole"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("value"),
    )

    def length(piece: Column) -> Column:  # the last piece has a gap only
        return piece["gap"] + F.coalesce(piece["whole"], F.lit(0))

    def in_tile(start: Column, own: Column) -> Column:
        def step(state: Column, piece: Column) -> Column:
            begin, end = state["at"] + piece["gap"], state["at"] + length(piece)
            span = F.struct(begin.alias("start"), end.alias("stop"))
            return F.struct(end.alias("at"), F.when(piece["value"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(own, F.struct(start.alias("at"), F.array().cast(_SPAN).alias("spans")), step, lambda state: state["spans"])

    def found(p: Column) -> Column:
        sums = F.transform(_tiles(F.size(p)), lambda k: F.aggregate(_tile(p, k), F.lit(0), lambda s, x: s + length(x)))

        def tiled(s: Column) -> Column:
            before = lambda k: F.aggregate(F.slice(s, F.lit(1), k), F.lit(0), lambda t, x: t + x)
            return F.flatten(F.transform(_tiles(F.size(p)), lambda k: in_tile(before(k), _tile(p, k))))

        return _once(sums, tiled)

    return F.when(text.rlike(rule.pattern), _once(pieces, found)).otherwise(F.array().cast(_SPAN))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value made a single time."""
    return F.get(F.transform(F.array(value), use), 0)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(_LEDGER).parquet(ledger)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the unseen blob and rule-version pairs; the (doc_id, blob) of all rows comes back."""
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", blob(F.col("text")))
    paths = kept_table(own.select("doc_id", "blob"), "paths")
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    keys = F.array(*(F.lit(r.key) for r in rules))
    if _exists(spark, ledger):
        seen = read_ledger(spark, ledger).groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").select("blob", "doc_id", F.coalesce(F.array_except(keys, "seen"), keys).alias("todo"))
    else:
        blobs = blobs.select("blob", "doc_id", keys.alias("todo"))
    unseen = blobs.where(F.size("todo") > 0).select(F.col("blob").alias("_blob"), F.col("doc_id").alias("_id"), "todo")
    texts = own.join(unseen.hint("shuffle_hash"), (own["blob"] == F.col("_blob")) & own["doc_id"].eqNullSafe(F.col("_id")))
    found = [
        F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), rule_spans(F.col("text"), r).alias("spans"))) for r in rules
    ]
    scanned = texts.select("blob", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("blob", "x.rule", "x.version", "x.spans")
    scanned.write.mode("append").parquet(ledger)
    return paths


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and spans (kind, rank, start, stop; by start, then kind as listed) of blobs with a finding."""
    ranks = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)))
    key = F.concat_ws(":", "rule", "version")
    rows = read_ledger(spark, ledger).where(F.size("spans") > 0).withColumn("rank", ranks[key]).where(F.col("rank").isNotNull())
    one = rows.select("blob", F.col("rule").alias("kind"), "rank", F.explode("spans").alias("s")).select("blob", F.struct(F.col("s.start").alias("start"), "rank", "kind", F.col("s.stop").alias("stop")).alias("span"))
    return one.groupBy("blob").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])))


def _of_kinds(*rules: Rule) -> Column:
    return F.filter("s", lambda x: x["kind"].isin([r.kind for r in rules]))


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every row."""
    paths = update_ledger(docs, ledger, rules)
    found = findings(docs.sparkSession, ledger, rules)
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>"))
    rows = paths.join(found, "blob", "left").select("doc_id", spans.alias("s"))
    return rows.select(
        "doc_id",
        *(F.size(_of_kinds(r)).cast("long").alias(f"n_{r.kind}") for r in BASE),
        F.sha2(_joined(_of_kinds(*BASE)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("s")).alias("spans"),
    )


def _masked(raw: Column, spans: Column, mask: Column) -> Column:
    """The text with the union of the spans masked, one mask for each run of spans that overlap."""

    def farthest(own: Column, first: Column) -> Column:
        return F.aggregate(own, first, lambda s, x: F.greatest(s, x["stop"]))

    def bounds(k: Column, start: Column) -> Column:
        """Where each span of a tile begins and how far the ones before it reach."""
        zero = F.struct(start.alias("reach"), F.array().cast("array<struct<start:int,reach:int>>").alias("out"))
        step = lambda s, x: F.struct(F.greatest(s["reach"], x["stop"]).alias("reach"), F.concat(s["out"], F.array(F.struct(x["start"].alias("start"), s["reach"].alias("reach")))).alias("out"))
        return F.aggregate(_tile(spans, k), zero, step, lambda s: s["out"])

    def piece(a: Column, b: Column) -> Column:
        return F.decode(F.substring(raw, a * 4 + 1, (b - a) * 4), "UTF-32")

    def joined(reaches: Column) -> Column:
        before = lambda k: F.array_max(F.concat(F.array(F.lit(0)), F.slice(reaches, F.lit(1), k)))
        all_bounds = F.flatten(F.transform(_tiles(F.size(spans)), lambda k: bounds(k, before(k))))
        fresh = F.filter(all_bounds, lambda x: x["start"] >= x["reach"])
        heads = F.transform(fresh, lambda x: F.concat(piece(x["reach"], x["start"]), mask))
        last = F.array_max(reaches)
        return F.concat(F.array_join(heads, ""), piece(last, (F.octet_length(raw) / 4).cast("int")))

    return _once(F.transform(_tiles(F.size(spans)), lambda k: farthest(_tile(spans, k), F.lit(0))), joined)


def redact(docs: DataFrame, ledger: str, mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span replaced by ``mask`` and ``n_chars``, if there, counted anew."""
    update_ledger(docs, ledger, rules)
    found = findings(docs.sparkSession, ledger, rules).select(F.col("blob").alias("__redact_blob"), F.col("spans").alias("__redact_spans"))
    def clean(text: Column) -> Column:
        # four bytes a code point: any piece is cut out without reading what lies before it
        return _once(F.struct(F.encode(text, "UTF-32").alias("raw"), F.col("__redact_spans").alias("spans")), lambda x: _masked(x["raw"], x["spans"], F.lit(mask)))

    joined = docs.withColumn("__redact_hash", blob(F.col("text"))).join(found, F.col("__redact_hash") == F.col("__redact_blob"), "left")
    text = F.when(F.col("__redact_spans").isNull(), F.col("text")).otherwise(clean(F.col("text")))
    # behind a generator the masked text is made once, for itself and for its length
    made = joined.select("*", F.explode(F.array(text)).alias("__redact_text"))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("__redact_text").alias(name))
        elif name == "n_chars":
            count = F.when(F.col("__redact_spans").isNull(), F.col(name)).otherwise(F.length("__redact_text"))
            columns.append(count.cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col(f"`{name}`"))
    return made.select(*columns)
