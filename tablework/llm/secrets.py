"""Secret scans over content-addressed blobs, with a ledger of what has been scanned by which version of the rules.

Every historical version of a text is a blob, named by its SHA-256. Only pairs of blob and rule version that the ledger
lacks are scanned; findings are joined back to all rows, whatever their paths, that hold the blob. All of it is DataFrame
expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm.common import by_row, stage


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: a Java pattern whose matches are cut from left to right; group, least: the group that must have so many characters; version: raised with every change."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


#: In this order findings with the same start are listed. Greedy runs that must have n characters are written {n,}.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def blobs(versions: DataFrame) -> DataFrame:
    """versions with blob, the SHA-256 of the text; null as empty."""
    return versions.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.sha2("text", 256))


def _lists(rule: Rule) -> Column:
    """Per match: the text between it and the last one, its own length, and that of the group that counts; null without matches."""
    p = F.lit(rule.pattern)
    found = F.regexp_extract_all("text", p, F.lit(0))
    counts = F.regexp_extract_all("text", p, F.lit(rule.group)) if rule.group else found
    zipped = F.arrays_zip(F.transform(F.split("text", rule.pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("size"), F.transform(counts, F.length).alias("counts"))
    return F.when(F.col("text").rlike(rule.pattern), zipped)


def scan(unseen: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rules, spans) of blobs (blob, rules, text), each scanned by those rules it names: spans is an array of (start, rule, end), sorted; ends are exclusive, in code points."""
    lists = F.filter(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.when(F.array_contains("rules", r.name), _lists(r)).alias("matches")) for r in rules)), lambda x: x["matches"].isNotNull())
    each = unseen.select("blob", "rules", F.explode_outer(lists).alias("m")).select("blob", "rules", "m.rule", F.posexplode_outer("m.matches").alias("pos", "x"))
    so_far = Window.partitionBy("blob", "rule").orderBy("pos")
    # a match ends after all gaps up to its own and all matches up to itself
    each = each.withColumn("end", F.sum(F.col("x.gap") + F.coalesce("x.size", F.lit(0))).over(so_far))
    least = F.element_at(F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.least))), F.col("rule"))
    span = F.struct((F.col("end") - F.col("x.size")).alias("start"), "rule", "end")
    good = F.col("x.size").isNotNull() & (F.col("x.counts") >= least)
    return each.groupBy("blob", "rules").agg(F.array_sort(F.collect_list(F.when(good, span))).alias("spans"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger (blob, rules, spans) of all blobs of versions (text) and all it had.

    A row says which rules, by name and version, have scanned a blob and what they found. Only the pairs of blob and rule
    version that no row has are scanned, so a new blob is scanned by all rules and a changed rule alone goes over all blobs.
    The result is written to the shared folder; store it to scan only what is new the next time.
    """
    names = F.array(*(F.lit(r.name) for r in rules))
    new = blobs(versions.select("text")).dropDuplicates(["blob"]).withColumn("rules", names)
    if ledger is None:
        return stage(scan(new, rules), "ledger")
    seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    new = new.join(seen, "blob", "left").withColumn("rules", F.when(F.col("seen").isNull(), names).otherwise(F.array_except(names, "seen")))
    return stage(scan(new.where(F.size("rules") > 0), rules).unionByName(ledger.select("blob", "rules", "spans")), "ledger")


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a document (doc_id, text): doc_id, blob and spans (start, rank, kind, end), by way of the ledger.

    Null and empty texts have no spans; texts are scanned whole, however long. Repeated texts are scanned once and reported
    for every row; repeated doc_ids stay separate rows; spans with equal starts are in the rules' order; an empty table gives
    no rows; other columns aren't read.
    """
    known = update_ledger(docs, ledger, rules).select("blob", "spans")
    if ledger is not None:  # a blob has a row for each time that rules were new to it
        known = known.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    rank = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)))
    kind = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.kind)))
    spans = F.transform(F.filter("spans", lambda s: s["rule"].isin([r.name for r in rules])), lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["rule"]).alias("rank"), F.element_at(kind, s["rule"]).alias("kind"), s["end"].alias("end")))
    known = known.select("blob", F.array_sort(spans).alias("spans"))
    return blobs(docs.select("doc_id", "text")).select("doc_id", "blob").join(known, "blob", "left").select("doc_id", "blob", "spans")


def listing(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def summary(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """n_<kind> of the base kinds, base_sha256 of their spans and spans of all kinds as text, for find_secrets()."""
    base = [r.kind for r in rules if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(listing(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listing(F.col("spans")).alias("spans"),
    )


@by_row
def redact(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every finding in text replaced by mark; overlapping findings by one. Null texts stay null; every row has its own cuts, whatever its doc_id.

    n_chars, where docs has it, is counted anew for changed texts."""
    found = find_secrets(docs, None, rules).where(F.size("spans") > 0)
    hits = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end")
    by = Window.partitionBy("doc_id").orderBy("start", "end")
    hits = hits.withColumn("before", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    hits = hits.withColumn("run", F.sum((F.coalesce("before", F.lit(-1)) < F.col("start")).cast("int")).over(by))
    runs = hits.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    last = Window.partitionBy("doc_id").orderBy("start")
    runs = runs.withColumn("from", F.coalesce(F.lag("end").over(last), F.lit(0)))
    cuts = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "from"))).alias("cuts"))
    # columns of docs are packed, so that none of its names can clash
    joined = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")).join(cuts, "doc_id", "left")
    parts = F.transform("cuts", lambda c: F.concat(F.substring("text", c["from"] + 1, c["start"] - c["from"]), F.lit(mark)))
    tail = F.expr("substring(text, int(element_at(cuts, -1).end) + 1)")
    clean = F.col("cuts").isNull()
    joined = joined.select("row", "cuts", F.when(clean, F.col("text")).otherwise(F.concat(F.array_join(parts, ""), tail)).alias("text"))
    new = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.when(clean, F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return joined.select(new.alias("row")).select("row.*")
