"""Secret scans with a ledger of blobs: every content is scanned once for each version of a rule.

A version of a path is a row (path, content). Contents are addressed by their
SHA-256. The ledger, a folder, knows which (blob, rule, version) have been
scanned and what was found; a scan looks only at pairs it does not know, and
findings are joined back to every path that ever held the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.tables import packed, stash
from gridloom.session import new_dataset_path
from gridloom.sources.files import read_if_there


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count where ``group`` has ``least`` characters or more.

    ``hint`` matches in every content that has a counted match; others are not
    looked at further. A changed rule wants a new version.
    """

    name: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str


#: Kinds of secrets, in the order in which findings at one place are listed.
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]%s)"""
RULES = (
    Rule("assign", 1, _ASSIGN % "+", 2, 8, _ASSIGN % "{8,}"),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 16, "AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, "[0-9a-f]+", 0, 32, "[0-9a-f]{32,}"),
)
SCANNED = "digest string, rule string, version int"
FINDINGS = "digest string, rule string, version int, start long, end long"


def new_ledger(spark: SparkSession) -> str:
    return new_dataset_path(spark, "blob-ledger")


def digest(content: Column) -> Column:
    """Address of a content; null is the empty content."""
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def scan(versions: DataFrame, ledger: str, rules=RULES) -> None:
    """Scan what the ledger has not seen of ``versions`` (content, digest) and enter it.

    Findings are written before the pairs they belong to, so a scan that breaks
    off is repeated by the next one; readers take equal findings once.
    """
    spark = versions.sparkSession
    known = _read(spark, f"{ledger}/scanned", SCANNED)
    every = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    pairs = versions.select("digest").distinct().select("digest", F.inline(every))
    pending = stash(pairs.join(known, ["digest", "rule", "version"], "left_anti"), "blob-pending")
    todo = pending.groupBy("digest").agg(F.collect_set(F.concat_ws("@", "rule", "version")).alias("todo"))
    fresh = versions.select("digest", F.coalesce("content", F.lit("")).alias("content")).dropDuplicates(["digest"]).join(todo, "digest")
    hits = F.array(*[
        F.when(F.array_contains("todo", f"{r.name}@{r.version}"), F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), _lengths(F.col("content"), r).alias("parts"),
        )) for r in rules
    ])
    found = fresh.select("digest", F.explode(F.filter(hits, lambda h: F.size(h["parts"]) > 0)).alias("hit"))
    found = found.select("digest", "hit.rule", "hit.version", "hit.least", F.posexplode("hit.parts").alias("at", "part"))
    order = Window.partitionBy("digest", "rule", "version").orderBy("at")
    end = F.sum(F.col("part.gap") + F.col("part.length")).over(order)
    found = found.select("digest", "rule", "version", "part", "least", end.cast("long").alias("end")).where("part.value >= least")
    found = found.select("digest", "rule", "version", (F.col("end") - F.col("part.length")).alias("start"), "end")
    found.write.mode("append").parquet(f"{ledger}/findings")
    pending.write.mode("append").parquet(f"{ledger}/scanned")


def _lengths(content: Column, rule: Rule) -> Column:
    """(gap before, length, length of the counted group) of each match, in characters, in order; empty where there is none."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(content, pattern, F.lit(0))
    value = F.regexp_extract_all(content, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(content, rule.pattern, -1)
    parts = F.zip_with(F.zip_with(whole, value, lambda w, v: F.struct(F.length(w).alias("length"), F.length(v).alias("value"))),
                       F.slice(gaps, F.lit(1), F.size(whole)),
                       lambda m, g: F.struct(F.length(g).alias("gap"), m["length"].alias("length"), m["value"].alias("value")))
    return F.when(content.rlike(rule.hint), parts).otherwise(F.slice(parts, 1, 0))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    found = read_if_there(spark, path, schema)
    # The first scan has no ledger yet.
    return spark.createDataFrame([], schema) if found is None else found


def spans_by_blob(spark: SparkSession, ledger: str, rules=RULES) -> DataFrame:
    """(digest, spans) of blobs with findings; spans are (start, place of the rule, kind, end), by start, then rule."""
    found = _read(spark, f"{ledger}/findings", FINDINGS).distinct()
    place = F.coalesce(*[F.when((F.col("rule") == r.name) & (F.col("version") == r.version), i) for i, r in enumerate(rules)])
    found = found.withColumn("place", place).where("place is not null")
    span = F.struct("start", "place", F.col("rule").alias("kind"), "end")
    return found.groupBy("digest").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def find_secrets(versions: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """Scan ``versions`` (path, content), then (path, digest, spans) for every one of its rows.

    Null and empty contents have no spans. Repeated rows come back as often as
    they are. Offsets count characters (code points).
    """
    versions = versions.select("path", "content", digest(F.col("content")).alias("digest"))
    scan(versions, ledger, rules)
    paths = versions.select("path", "digest")
    spans = spans_by_blob(versions.sparkSession, ledger, rules)
    kind = spans.schema["spans"].dataType.simpleString()
    return paths.join(spans, "digest", "left").select("path", "digest", F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, rule: Rule) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == rule.name)).cast("long")


def redact(docs: DataFrame, ledger: str, rules=RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans are one. Rows and other columns stay."""
    scan(docs.select(F.col("text").alias("content"), digest(F.col("text")).alias("digest")), ledger, rules)
    spans = spans_by_blob(docs.sparkSession, ledger, rules)
    marked = docs.select(packed(docs), digest(F.col("text")).alias("digest"))
    text, start = F.col("row")["text"], F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, span: Column) -> Column:
        gap = F.when(span["start"] < done["at"], F.lit("")).otherwise(
            F.concat(F.substring(text, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int")), F.lit(mark)))
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.concat(done["out"], gap).alias("out"))

    clean = F.aggregate("spans", start, step, lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.lit(2147483647))))
    clean = F.when(F.col("spans").isNull(), text).otherwise(clean)
    joined = marked.join(spans, "digest", "left")
    return joined.select(*[(clean if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


#: What the query over ``documents`` returns. Runs of digits or capitals are maximal, so their least length may stand in the pattern.
_PATTERNS = {"assign": (RULES[0].pattern, 2, 8), "access": (RULES[1].hint, 0, 0), "hex": (RULES[2].hint, 0, 0)}
SQL = (
    "with t as (select doc_id, coalesce(text, '') as t from documents), m as ("
    + " union all ".join(
        f"""select doc_id, {i} as place, '{kind}' as kind, {least} as least, string_split_regex(t, $p${p}$p$) as gaps,
            regexp_extract_all(t, $p${p}$p$) as whole, regexp_extract_all(t, $p${p}$p$, {group}) as part from t"""
        for i, (kind, (p, group, least)) in enumerate(_PATTERNS.items()))
    + """), u as (select *, unnest(range(1, len(whole) + 1)) as i from m),
v as (select doc_id, place, kind, least, length(part[i]) as n, length(whole[i]) as w,
             sum(length(gaps[i]) + length(whole[i])) over (partition by doc_id, place order by i) as stop from u),
s as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
             string_agg(kind || ':' || (stop - w)::bigint || ':' || stop::bigint, ',' order by stop - w, place) as spans from v where n >= least group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join s using (doc_id)
"""
)
