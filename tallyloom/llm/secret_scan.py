"""Secret scan over every version of every text, through a ledger of what has been scanned already."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.storage import stored
from tallyloom.llm.words import text_key, whole


@dataclass(frozen=True)
class Rule:
    """A pattern; what counts is the length of ``group``. A changed rule gets a new version and is scanned anew."""

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in the order in which spans with one start are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: A private key block reaches through its END line; without one, through header lines and the base64 lines that follow, a
#: last short one included. Line breaks may be written as backslash and letter. Repeats are possessive, so no text is slow.
_KEY_MARK = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_BREAK = r"(?:\s|\\[nrt])"
_PEM = (rf"-----BEGIN {_KEY_MARK}(?:[^-]*+(?:-{{1,4}}(?!-)[^-]*+)*+-----END {_KEY_MARK}"
        rf"|(?:{_BREAK}++[A-Z][A-Za-z-]{{2,}}+: [^\r\n\\]*+)*+"
        rf"(?:{_BREAK}++[A-Za-z0-9+/]{{32,}}+={{0,2}}+(?![A-Za-z0-9+/_=]))++"
        rf"(?:{_BREAK}++[A-Za-z0-9+/]{{1,31}}+={{0,2}}+(?=[\x20\t]*+(?:[\r\n\\]|\z)))?+)?+")
#: Kinds beside the base: private key blocks, tokens of code hosts, signed web tokens.
ADDED = (
    Rule("pem", _PEM, version=3),
    Rule("hosttoken", r"gh[oprsu]_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED
SPAN = "struct<start:int,rank:int,kind:string,end:int>"
LEDGER = f"blob string, rule string, spans array<{SPAN}>"
#: Most blobs with findings whose keys of 8 bytes are sent to every executor, which holds them in about 50 MB.
SENT_BLOBS = 1 << 20


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost, non-overlapping matches with their places in code points, end excluded.

    What lies between the matches is the text split by the pattern, so places are running sums of lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    triples = F.zip_with(F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches)), matches,
                                    lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("width"))),
                         counted, lambda x, c: F.struct(x["gap"].alias("gap"), x["width"].alias("width"),
                                                        F.length(c).alias("counts")))
    start = F.struct(F.lit(0).alias("at"), _none().alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"),
                        (begin + x["width"]).alias("end"))
        return F.struct((begin + x["width"]).alias("at"),
                        F.when(x["counts"] >= rule.shortest, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.when(F.regexp_like(text, F.lit(rule.pattern)), F.aggregate(triples, start, step, lambda acc: acc["found"])).otherwise(_none())


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text",
                rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule, spans): every distinct text under every rule version not in the ledger yet.

    A blob's address is the SHA-256 of its text. Copies meet before they are scanned, and a task passes on
    one copy of each. A blob whose pairs are all in the ledger is not scanned. Rules are a short list in
    code; a pair without findings is a row too, so that it is known as seen.
    """
    blobs = (versions.select(text_key(F.col(text)).alias("blob"), whole(F.col(text)).alias("blob_text"))
             .groupBy("blob").agg(F.any_value("blob_text").alias("blob_text")))
    names = F.array(*(F.lit(rule.name) for rule in rules))
    if ledger is None:
        todo = blobs.withColumn("todo", names)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        left = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", left).filter(F.size("todo") > 0).drop("seen")
    results = F.array(*(F.when(F.array_contains("todo", rule.name), F.struct(
        F.lit(rule.name).alias("rule"), spans_of(F.col("blob_text"), rule, rank).alias("spans")))
        for rank, rule in enumerate(rules)))
    return (todo.select("blob", F.explode(F.filter(results, lambda r: r.isNotNull())).alias("r"))
            .select("blob", "r.rule", "r.spans"))


def findings_of(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``findings``: all spans of the row's text under the current rules, by start and then kind.

    Findings are stored, one row per blob that has any, so that the join with the rows is a plain one whose hot
    blobs (copies of one text) adaptive execution can split. Hashes of up to ``SENT_BLOBS`` such blobs are sent to the
    rows, and only rows that meet one are shuffled; for more blobs all are. A pair that stands in the ledger twice counts once.
    """
    current = ledger.filter(F.col("rule").isin([rule.name for rule in rules]) & (F.size("spans") > 0))
    by_blob = current.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("findings"))
    by_blob = stored(by_blob, "findings")
    rows = versions.drop("findings").withColumn("__blob", text_key(versions[text]))
    kept = [rows[c] for c in versions.columns if c != "findings"]
    joined = lambda some: some.join(by_blob, rows["__blob"] == by_blob["blob"], "left").select(
        *kept, F.coalesce("findings", _none()).alias("findings"))
    if by_blob.count() > SENT_BLOBS:
        return joined(rows)
    # A row whose hash only collides with one that is sent finds nothing in the join.
    sent = F.broadcast(by_blob.select(F.xxhash64("blob").alias("sent")))
    met = F.xxhash64(rows["__blob"]) == sent["sent"]
    rest = rows.join(sent, met, "left_anti").select(*kept, _none().alias("findings"))
    return joined(rows.join(sent, met, "left_semi")).union(rest)


def scan_secrets(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with the findings of each row, scanning only what ``ledger`` does not hold.

    Append ``scan_unseen`` of the same arguments to the ledger to keep what this run found. NULL and empty
    texts are the empty blob and have no findings; repeated rows stay; no rows give none; a column
    named ``findings`` is replaced, all others are kept. A rule that matches nothing, or whose match
    is too short, adds no span; the match is passed over as a whole.
    """
    fresh = scan_unseen(versions, ledger, text, rules)
    return findings_of(versions, fresh if ledger is None else ledger.unionByName(fresh), text, rules)


def scan_with_ledger(versions: DataFrame, folder: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with the findings of each row, through the ledger stored in ``folder``.

    What the folder does not hold yet is scanned and appended to it, in one commit; findings are then joined from the
    folder, those of earlier runs included. The folder is made where it is missing. A run that dies before its
    commit leaves the ledger as it was; two runs at once may both scan a blob, whose pairs then count once. Odd
    rows are treated as ``scan_secrets`` does.
    """
    spark = versions.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(folder)
    ledger = spark.read.schema(LEDGER)
    scan_unseen(versions, ledger.parquet(folder), text, rules).write.mode("append").parquet(folder)
    return findings_of(versions, ledger.parquet(folder), text, rules)


def redact(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """The text with every finding replaced by a mark; findings that overlap share one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, f: Column) -> Column:
        kept = F.substr(text, acc["at"] + 1, f["start"] - acc["at"])
        inside = F.struct(F.greatest(acc["at"], f["end"]).alias("at"), acc["parts"].alias("parts"))
        return F.when(f["start"] < acc["at"], inside).otherwise(F.struct(
            f["end"].alias("at"), F.concat(acc["parts"], F.array(kept, F.lit(mark))).alias("parts")))

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"] + 1))
    return F.when(F.size(findings) > 0, F.aggregate(findings, start, step, rest)).otherwise(text)
