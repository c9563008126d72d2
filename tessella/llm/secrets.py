"""Secret scans with corpus-wide ownership frequency.

Candidates are found in each text; their hashes are then counted over distinct repositories and owners of the whole
corpus. A value that many owners or many repositories hold is a copied example; one that a few hold looks live.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import tables

#: Base kinds in their order, then the kind that ownership adds.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")


def find_candidates(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, hash of the secret value) of a text, in code points, by start and then kind.

    The base kinds are leftmost, don't overlap within their kind and are dropped, not retried, where they are too
    short. Kind token is any other run of 20 or more token characters with small and capital letters and digits; it
    is a candidate only, for ownership to decide.
    """
    if not text:
        return []
    found: list[tuple[str, int, int, str]] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    # The longest runs are the matches, so the least length can stand in the pattern.
    found += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    base = [x[1:3] for x in found]
    for m in _TOKEN.finditer(text):
        x = m[0]
        if re.search("[0-9]", x) and re.search("[a-z]", x) and re.search("[A-Z]", x) and not any(s < m.end() and m.start() < e for s, e in base):
            found.append(("token", *m.span(), x))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return [(k, s, e, hashlib.sha256(x.encode()).hexdigest()[:32]) for k, s, e, x in found]


def _scan(docs: DataFrame, text_col: str, id_col: str, owner_col: str, repo_col: str) -> DataFrame:
    tables.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            found = [find_candidates(x.as_py()) for x in batch.column("t")]
            base = [",".join(f"{k}:{s}:{e}" for k, s, e, _ in c if k != "token") for c in found]
            out = {
                "row": pa.array(range(row, row + len(found)), pa.int64()), "doc_id": batch.column("i"), "owner": batch.column("o"), "repo": batch.column("r"),
                **{f"n_{kind}": pa.array([sum(x[0] == kind for x in c) for c in found], pa.int64()) for kind in BASE_KINDS},
                "base": pa.array(base, pa.string()), "base_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
                "candidates": pa.array([[dict(zip(("kind", "start", "end", "hash"), x)) for x in c] for c in found], fields[-1].type),
            }
            row += len(found)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"row long, doc_id {kind}, owner string, repo string, n_assign long, n_access long, n_hex long, base string, base_sha256 string, candidates array<struct<kind:string,start:long,end:long,hash:string>>"
    fields = tables.arrow_fields(docs.sparkSession, ddl)
    named = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("o"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("r"), F.col(text_col).alias("t"))
    return named.mapInArrow(run, ddl)


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos: distinct owners and repositories that hold each candidate hash.

    Pairs are made distinct before they are counted, so a hash that a third of all rows hold moves as one row per
    task and owner.
    """
    owners = candidates.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    repos = candidates.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "hash")


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source", repo_col: str = "doc_id", copied_from: int = 3, copied_repos: int = 10) -> DataFrame:
    """Secrets of each whole text, told apart by how many owners and repositories hold the same value.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, held. A value of `copied_from` or
    more distinct owners, or of `copied_repos` or more distinct repositories, is copied, any other live. Spans holds all
    base spans, and token spans whose value is live; held has every candidate with its owners and repositories. A row
    for each input row; null texts have no spans; a null owner or repository counts as one of its own; repeated rows
    are scanned each; other columns aren't read.

    The scan is one narrow pass whose candidates are written to the shared folder, as is the ownership of their values;
    only candidates are shuffled. Texts of any length are scanned whole.
    """
    scanned = tables.keep(_scan(docs, text_col, id_col, owner_col, repo_col), "secrets")
    flat = scanned.where(F.size("candidates") > 0).select("row", "owner", "repo", F.explode("candidates").alias("c")).select("row", "owner", "repo", "c.*")
    # Written first, so that its size is known where it is joined: a small one goes to all tasks, and a value that a third
    # of rows hold can be split where it doesn't.
    owned = tables.keep(ownership(flat), "ownership")
    judged = flat.select("row", "kind", "start", "end", "hash").join(owned, "hash")
    live = (F.col("n_owners") < copied_from) & (F.col("n_repos") < copied_repos)
    one = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k"), "end", "kind", "n_owners", "n_repos", live.alias("live"))
    per_row = judged.groupBy("row").agg(F.sum(live.cast("long")).alias("n_live"), F.sum((~live).cast("long")).alias("n_copied"), F.sort_array(F.collect_list(one)).alias("held"))
    listed = lambda rows, *more: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], *(x[c].cast("string") for c in ("start", "end", *more)))), ",")
    shown = F.filter("held", lambda x: (x["kind"] != "token") | x["live"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = scanned.join(per_row.select("row", "n_live", "n_copied", listed(shown).alias("spans"), listed("held", "n_owners", "n_repos").alias("held")), "row", "left")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_copied"), F.coalesce("held", F.lit("")).alias("held"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
