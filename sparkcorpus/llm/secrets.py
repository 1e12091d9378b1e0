"""Secret scans: spans by pattern, judged by who owns them across the corpus.

Three base kinds are always reported. Further candidates, which are long tokens of letters and digits, are too common to
report by shape alone, so the corpus decides: the hash of each candidate is counted over distinct repositories and
owners. A value in EXAMPLE_OWNERS owners or EXAMPLE_REPOS repositories is a copied example, whoever owns them; one of a
single owner in LIVE_REPOS repositories or fewer is a live-looking credential, and a candidate of that kind is reported
if its characters look random. All others are shared. The same counts say for the base spans which are examples.

Counts are exact and over all rows: (hash, owner, repository) is made distinct first, with a combine before the shuffle,
so a value that a third of all documents copy is a few rows. Only hashes of values leave a task, never the values.

Edge cases: a null text is empty. Null owners or repositories count as one more owner or repository. Offsets are code
points, end exclusive. A very long text is scanned whole; its time follows its length and number of spans. Spans that
start at one place are in the order of their kinds. Repeated ids: results are by row inside the scan; the added spans of
rows with the same id and the same text are the same, and rows are told apart by a hash of their text otherwise. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Fixed patterns of the base kinds, in their order: (kind, pattern, group that is the value, its least length).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: What the method may add: a run of token characters that has letters and digits.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}")
#: A value with so many owners, or in so many repositories, or more, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 6
#: A value of one owner is live in so many repositories at most.
LIVE_REPOS = 2
#: Bits of entropy that each character of a random-looking value has at least.
ENTROPY = 2.5
ORDER = {kind: i for i, (kind, *_) in enumerate(BASE)} | {"owned": len(BASE)}
SPAN = "struct<kind:string,start:bigint,end:bigint,value:bigint>"


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, start and end of the value) of the base kinds, by start and then kind."""
    found = []
    for kind, pattern, group, least in BASE:
        # the shortest run that counts as hex is rare, so runs that are too short needn't be listed
        for m in re.finditer(r"[0-9a-f]{32,}", text) if kind == "hex" else pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), m.end(), kind, m.start(group), m.end(group)))
    return sorted(found, key=lambda x: (x[0], ORDER[x[2]]))


def apart(found: list[tuple[int, int]], base: list[tuple]) -> list[tuple[int, int]]:
    """Those of the spans (start, end) that touch none of the base spans (start, end, ...), which are sorted by start."""
    starts, ends = [x[0] for x in base], list(accumulate((x[1] for x in base), max))
    # of the base spans that start before the end, the one that reaches farthest decides
    return [(a, z) for a, z in found if not (k := bisect_left(starts, z)) or ends[k - 1] <= a]


def entropy(value: str) -> float:
    """Bits for each character, by the value's own frequencies."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{z}" for a, z, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | Column = "source", repo_col: str | Column = "source") -> DataFrame:
    """Rows (id, row, owner, repo, n_assign, n_access, n_hex, base_sha256, base, more), one for each row of docs.

    base and more hold spans with the hash of their value; more are the candidates that don't touch a base span.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows, n = [], {kind: [] for kind, *_ in BASE}
            for text in part.column("text").to_pylist():
                text = text or ""
                own = base_spans(text)
                hashed = lambda a, z, text=text: xxhash.xxh64_intdigest(text[a:z]) - (1 << 63)
                base = [{"kind": k, "start": a, "end": z, "value": hashed(va, vz)} for a, z, k, va, vz in own]
                tokens = apart([m.span() for m in CANDIDATE.finditer(text) if entropy(m[0]) >= ENTROPY], own)
                more = [{"kind": "owned", "start": a, "end": z, "value": hashed(a, z)} for a, z in tokens]
                kinds = Counter(k for _, _, k, *_ in own)
                for kind in n:
                    n[kind].append(kinds[kind])
                rows.append((hashlib.sha256(listed([x[:3] for x in own]).encode()).hexdigest(), base, more, xxhash.xxh64_intdigest(text) - (1 << 63)))
            sha, base, more, row = zip(*rows, strict=True)
            spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))
            yield pa.record_batch({"id": part.column("id"), "row": pa.array(row, pa.int64()), "owner": part.column("owner"),
                "repo": part.column("repo")} | {f"n_{k}": pa.array(v, pa.int64()) for k, v in n.items()} | {"base_sha256": pa.array(sha),
                "base": pa.array(base, spans), "more": pa.array(more, spans)})

    named = lambda c: F.coalesce((c if isinstance(c, Column) else F.col(f"`{c}`")).cast("string"), F.lit(""))
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), named(owner_col).alias("owner"), named(repo_col).alias("repo"))
    counts = ", ".join(f"n_{kind} long" for kind, *_ in BASE)
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, row long, owner string, repo string, {counts}, base_sha256 string, base array<{SPAN}>, more array<{SPAN}>")


def ownership(scanned: DataFrame) -> DataFrame:
    """Rows (value, n_repos, n_owners, n_copies): for each value's hash, over the whole corpus."""
    uses = scanned.select("owner", "repo", F.explode(F.concat("base.value", "more.value")).alias("value"))
    pairs = uses.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_copies"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | Column = "source",
    repo_col: str | Column = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS, live_repos: int = LIVE_REPOS) -> DataFrame:
    """Rows (id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples), one for each row of docs.

    spans: structs with start, end, kind, verdict (live, shared or example), n_owners, n_repos and n_copies, by start and
    then kind. Candidates are in it if they are live.
    """
    scanned = materialize(scan(docs, id_col, text_col, owner_col, repo_col))
    used = scanned.where("size(base) + size(more) > 0").select("id", "row", F.explode(F.concat("base", "more")).alias("s")).select("id", "row",
        "s.*").distinct()
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    live = (F.col("n_owners") == 1) & (F.col("n_repos") <= live_repos)
    verdict = F.when(example, "example").when(live, "live").otherwise("shared")
    judged = used.join(ownership(scanned), "value").withColumn("verdict", verdict).where("kind <> 'owned' or verdict = 'live'")
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in ORDER.items() for x in kv)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "end", "kind", "verdict", "n_owners", "n_repos", "n_copies")
    spans = judged.groupBy(F.col("id").alias("of"), F.col("row").alias("at")).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    rows = scanned.join(spans, F.col("id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("at")), "left")
    n = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    counts = (n("live").alias("n_live"), n("example").alias("n_examples"))
    return rows.withColumn("spans", F.coalesce("spans", F.array())).select("id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", *counts)
