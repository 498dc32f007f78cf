"""Secret scans with corpus-wide ownership frequency.

Spans of three fixed kinds are found in every text, and besides them bare candidates: long mixed tokens without a
key word in front. Candidate values travel as hashes. The hashes are aggregated by distinct repositories and owners
over the whole corpus. A value that few owners hold looks live: it belongs to someone. A value that many owners hold
was copied from documentation or a licence: an example. Bare candidates become spans only where they look live and
are also assigned to a key somewhere, or are random enough by themselves.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut, release, text_rows, with_fields

#: The three base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
#: A token that has a capital, a small letter and a digit, of 24 characters or more, is a bare candidate.
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{24,}")
KINDS = ("assign", "access", "hex", "bare")
#: More distinct owners than this hold a value: it is an example.
OWNERS = 2
#: So do more distinct repositories: one owner may keep copies in several.
REPOS = 4
#: Spans of one value are dealt over so many tasks.
SALTS = 16
#: Bits a character from which a bare candidate counts as random.
RANDOM_BITS = 4.0


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) by start, then kind. Matches that are too short are dropped after matching."""
    out = []
    if KEYWORDS.search(text):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def bare_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Bare candidates that no base span overlaps."""
    if not _LONG.search(text):
        return []
    found = [(m.start(), 3, m.end(), m[0]) for m in BARE.finditer(text)]
    return [x for x in found if all(x[2] <= t[0] or x[0] >= t[2] for t in taken)]


_LONG = re.compile(r"[A-Za-z0-9+/_=-]{24}")


def render(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def candidates(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, rid (a number for each row), c array<struct<s, k, e, h, r>>: h the value's hash, r whether it is random."""
    rows = text_rows(docs, text_col, *keep).withColumn("rid", F.monotonically_increasing_id())
    schema = with_fields(rows.select(*keep, "rid"), "c array<struct<s:int,k:int,e:int,h:bigint,r:boolean>>")
    kind = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("h", pa.int64()), ("r", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                out = []
                for text in b.column("__text").to_pylist():
                    base = base_spans(text)
                    found = sorted(base + bare_spans(text, base))
                    out.append([{"s": s, "k": k, "e": e, "h": xxhash.xxh64_intdigest(v.encode(), 7) - (1 << 63), "r": k < 3 or _entropy(v) >= RANDOM_BITS} for s, k, e, v in found])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), b.column("rid"), pa.array(out, kind)], [*keep, "rid", "c"])

    return rows.mapInArrow(run, schema)


def ownership(found: DataFrame, repo_col: str, owner_col: str) -> DataFrame:
    """h, n_repos, n_owners, n_places, assigned: how the corpus holds each value. Null repositories and owners count as one."""
    each = found.select(F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.explode("c").alias("c"))
    once = each.groupBy("c.h", "repo", "owner").agg(F.count("*").alias("n"), F.max((F.col("c.k") == 0).cast("int")).alias("a"))
    by_owner = once.groupBy("h", "owner").agg(F.sum("n").alias("n"), F.max("a").alias("a"), F.count("*").alias("repos"))
    repos = once.groupBy("h", "repo").agg(F.count("*").alias("x")).groupBy("h").agg(F.count("*").alias("n_repos"))
    owners = by_owner.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_places"), (F.max("a") == 1).alias("assigned"))
    return owners.withColumn("n_repos", F.col("n_owners")) if repo_col == owner_col else owners.join(repos, "h")


def scan(docs: DataFrame, keep: list[str], repo_col: str = "source", owner_col: str = "source", text_col: str = "text", owners: int = OWNERS, repos: int = REPOS) -> DataFrame:
    """One row per row of docs: keep, spans array<struct<s, k, e, live>> in order.

    A null or empty text has no spans; an empty table gives no row. Repeated rows each give a row and count as one owner.
    Columns that are not named are not read. Base spans always stay, live or not; bare ones only where they look live. A
    value is live where few distinct owners and few distinct repositories hold it.
    """
    cols = list(dict.fromkeys([*keep, repo_col, owner_col]))
    found = cut(candidates(docs, cols, text_col))
    verdict = ownership(found, repo_col, owner_col).select("h", ((F.col("n_owners") <= owners) & (F.col("n_repos") <= repos)).alias("live"), "assigned")
    # a value may be copied into a third of all rows: its spans are dealt over SALTS tasks
    verdict = verdict.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spans = found.where("size(c) > 0").select("rid", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("salt"), F.explode("c").alias("c")).select("rid", "salt", "c.*")
    judged = spans.join(verdict, ["h", "salt"]).where("k < 3 or (live and (assigned or r))")
    whole = judged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("s", "k", "e", "live"))).alias("spans"))
    out = found.join(whole, "rid", "left")
    return out.select(*keep, F.coalesce("spans", F.array().cast("array<struct<s:int,k:int,e:int,live:boolean>>")).alias("spans"))


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and n_live. Cases are those of scan(); a null source is one."""
    s = scan(docs.select("doc_id", "text", "source"), ["doc_id"])
    text = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("bigint")
    joined = lambda c: F.array_join(F.transform(c, text), ",")
    return s.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(joined(F.filter("spans", lambda x: x["k"] < 3)), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("bigint").alias("n_live"),
    )


def _outer(spans: str):
    """Live spans that lie in no other live span."""
    inside = lambda x: F.exists(spans, lambda y: y["live"] & (y["e"] >= x["e"]) & ((y["s"] < x["s"]) | (y["s"] == x["s"]) & ((y["e"] > x["e"]) | (y["k"] < x["k"]))))
    return F.filter(spans, lambda x: x["live"] & ~inside(x))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every live-looking span replaced by [SECRET:<kind>]; examples stay. n_chars, where present, follows.

    Rows keep their order of columns; a null text stays null. Rows that repeat id and text are redacted alike.
    """
    rows = docs.withColumn("__h", F.xxhash64(text_col))
    s = scan(rows, [id_col, "__h"], text_col=text_col)
    live = s.select(F.col(id_col).alias("__i"), F.col("__h").alias("__k"), _outer("spans").alias("__live")).where("size(__live) > 0")
    live = live.dropDuplicates(["__i", "__k"])
    joined = rows.join(live, rows[id_col].eqNullSafe(live["__i"]) & (rows["__h"] == live["__k"]), "left")

    # spans from the last to the first: what stands before a span doesn't move; overlapping ones are cut at the next start
    def replace(acc, x):
        end = F.least(x["e"], acc["at"])
        put = F.concat(F.substring(acc["t"], F.lit(1), x["s"]), F.lit("[SECRET:"), F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), F.lit("]"), F.substring(acc["t"], end + 1, F.length(acc["t"])))
        return F.struct(put.alias("t"), x["s"].alias("at"))

    start = F.struct(F.col(text_col).cast("string").alias("t"), F.lit(2147483647).alias("at"))
    new = F.aggregate(F.reverse("__live"), start, replace)["t"]
    out = joined.withColumn(text_col, F.when(F.col("__live").isNull(), F.col(text_col)).otherwise(new))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__live").isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base result of one text, without the operator: for tests."""
    t = text or ""
    found = []
    for k, pattern, group, least in ((0, ASSIGN, 2, 8), (1, ACCESS, 0, 16), (2, re.compile(r"[0-9a-f]+"), 0, 32)):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(t) if len(m[group]) >= least]
    n = [sum(1 for x in found if x[1] == k) for k in range(3)]
    return (*n, hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)).encode()).hexdigest())
