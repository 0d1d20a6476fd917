"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source has a target in words. It is taken whole as often as that goes, and the rest of the target is made up of
blocks of equal length: first the number of blocks is shared out to the sources by the highest quotients
``rest / (2 * seats + 1)``, then each source's blocks to its shards in the same way, so every quota is an integer. In a shard
the documents lie one after another in a seeded order, and the quota is taken as blocks in a row, round the end, from a seeded
block on. So of the documents taken in part there are few, at the ends.

A document counts as its words; null texts have none. Sources are ordered by code point, null last, and weigh 5, 2, 1 and
so on again. Null ids stay null; repeated rows are taken one by one; an empty table gives an empty result. All of one
source's figures is one row, which is what the driver sees.
"""

from __future__ import annotations

import heapq
import hashlib
from itertools import cycle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.texts import WORD, small_batches, word_hashes
from cloakwork.plans.stored import stored

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 32
#: Blocks in a shard of the whole table.
SHARD = 65_536
SEED = "mix-1"


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """The sum of ``sizes`` shared out by weight; a share stops at ``most`` times its size and the others share the excess."""
    out: list[float] = [0.0] * len(sizes)
    free, open_ = float(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = free / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else unit * weights[i]
        free -= sum(out[i] for i in over)
        open_ = open_ - over if over else set()
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients ``votes / (2 * seats + 1)``, at most ``most`` each; ties go to the earlier one.

    Starts from the divisor that would be right without rounding and moves single seats from there.
    """
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = min(seats, int(most[votes > 0].sum()))
    if seats <= 0 or not votes.sum() > 0:
        return np.zeros(len(votes), np.int64)
    got = np.minimum(np.floor(votes * (seats / votes.sum()) + 0.5).astype(np.int64), most)
    up = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
    down = [(votes[i] / (2 * got[i] - 1), -i) for i in range(len(votes)) if got[i] > 0]
    heapq.heapify(up)
    heapq.heapify(down)
    total = int(got.sum())
    while total < seats:
        i = heapq.heappop(up)[1]
        got[i] += 1
        total += 1
        if got[i] < most[i]:
            heapq.heappush(up, (-votes[i] / (2 * got[i] + 1), i))
    while total > seats:
        i = -heapq.heappop(down)[1]
        got[i] -= 1
        total -= 1
        if got[i] > 0:
            heapq.heappush(down, (votes[i] / (2 * got[i] - 1), -i))
    return got


def _number(*parts: object) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def choose(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: str = SEED, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Per document: ``doc_id, t`` (its text's hash), ``source, size, source_size, target, copies`` (how often it is
    taken whole), ``parts`` (word ranges taken once more) and ``taken``, the words in all.

    ``carry``: columns of longs that go along; rows of one place and text are ordered by them."""
    small_batches(docs)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.xxhash64(whole).alias("t"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.regexp_count(whole, F.lit(WORD)).cast("long").alias("size"),
        *carry,
    )
    # the text takes part, so that rows without an id, or of one id, have a place each; only equal ones share theirs
    own = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("t").cast("string")]
    rows = stored(rows.withColumn("place", F.md5(F.concat_ws("|", F.lit(seed), *own))))
    sums = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    of = {r.source: r.n for r in sums}
    names = sorted(s for s in of if s is not None) + [None] * (None in of)
    sizes = [of[s] for s in names]
    goal = targets(sizes, [w for w, _ in zip(cycle(WEIGHTS), names)])
    copies = [int(g // n) if n else 0 for g, n in zip(goal, sizes)]
    rest = np.array([g - c * n for g, c, n in zip(goal, copies, sizes)])
    most = np.array([-(-n // block) for n in sizes], np.int64)
    quotas = sainte_lague(rest, int(rest.sum() / block + 0.5), most)
    plan = {s: (n, g, c, int(q)) for s, n, g, c, q in zip(names, sizes, goal, copies, quotas)}

    # by rows, too: empty texts have no words, and yet must not meet in one task
    shards = max(1, -(-sum(sizes) // (block * SHARD)), -(-sum(r.rows for r in sums) // SHARD))
    shard = F.conv(F.substring("place", 9, 8), 16, 10).cast("long") % shards
    rows = rows.withColumn("shard", shard)
    # every source's shards share its quota
    cells = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"))

    def share(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("shard").reset_index(drop=True)
        name = cells.source.iloc[0]
        most = -(-cells.words.to_numpy() // block)
        cells["quota"] = sainte_lague(cells.words.to_numpy(), plan[None if pd.isna(name) else name][3], most)
        return cells[["source", "shard", "quota"]]

    quota = cells.groupBy("source").applyInPandas(share, "source string, shard long, quota long")
    quota = quota.withColumnsRenamed({"source": "s", "shard": "h"})
    dealt = rows.join(quota, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h"))).drop("s", "h")

    def select(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["place", "t", *carry], kind="stable").reset_index(drop=True)
        name = None if pd.isna(cell.source.iloc[0]) else cell.source.iloc[0]
        size, goal, copies, _ = plan[name]
        ends = cell["size"].cumsum().to_numpy()
        starts = ends - cell["size"].to_numpy()
        total, quota = int(ends[-1]), int(cell.quota.iloc[0])
        blocks = -(-total // block)
        first = _number(seed, name, int(cell.shard.iloc[0])) % blocks if blocks else 0
        # blocks first .. first + quota - 1, those beyond the end from the beginning
        ranges = [(first * block, min(total, (first + quota) * block)), (0, max(0, first + quota - blocks) * block)]
        parts = [[(max(a, lo) - a, min(b, hi) - a) for lo, hi in ranges if max(a, lo) < min(b, hi)] for a, b in zip(starts, ends)]
        cell["parts"] = [[{"low": int(x), "high": int(y)} for x, y in sorted(p)] for p in parts]
        cell["copies"], cell["source_size"], cell["target"] = copies, size, goal
        cell["taken"] = [copies * int(n) + sum(int(y - x) for x, y in p) for n, p in zip(cell["size"], parts)]
        return cell[["doc_id", "t", "source", "size", "source_size", "target", "copies", "parts", "taken", *carry]]

    return dealt.groupBy("source", "shard").applyInPandas(
        select,
        "doc_id long, t long, source string, size long, source_size long, target double, copies long,"
        " parts array<struct<low:long,high:long>>, taken long" + "".join(f", {c} long" for c in carry),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", length: str = "n_chars") -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row for each whole copy and one for the words taken once more.

    ``length``, if there, is set to the new length in the rows of words. Of rows equal in id, source and text each takes what
    ``choose`` gave to it: every row is numbered before the choice and found again by its number.
    """
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rest = [F.col(i) for c, i in inner.items() if c not in (doc_id, text, source)]
    given = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in inner.items()])
    # stored, so that a row keeps its number; rows of one id and text are told apart by their other columns first
    given = stored(given.withColumns({"tie": F.xxhash64(F.to_json(F.struct(F.lit(0), *rest))), "row": F.monotonically_increasing_id()}))
    chosen = choose(given, inner[doc_id], inner[text], inner[source], carry=("tie", "row")).filter("taken > 0")
    joined = given.join(chosen.select("row", "copies", "parts"), "row")
    body = inner[text]

    @F.pandas_udf("array<string>")
    def rows_of(texts: pd.Series, copies: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for given, n, own in zip(texts, copies, parts):
            made = [given] * int(n)
            if len(own):
                raw = given.encode()
                starts, ends, _ = word_hashes(raw)
                made.append("\n".join(raw[starts[p["low"]] : ends[p["high"] - 1]].decode() for p in own))
            out.append(made)
        return pd.Series(out)

    new = joined.withColumn("new", F.explode(rows_of(body, "copies", "parts")))
    columns = {c: F.col(i) for c, i in inner.items()}
    columns[text] = F.col("new")
    if length in inner:
        columns[length] = F.length("new").cast(docs.schema[length].dataType)
    return new.select(*[v.alias(c) for c, v in columns.items()])
