"""Recall of op9_neighbours against brute force and the share of vectors that a query measures; run by hand.

python tests/llm/measure_neighbours.py FOLDER...: the folders' embeddings as they are, moved by 1e8, and times 1e39;
a folder after a + only as they are.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F

from wordmill.llm import neighbours as N
from wordmill.session import local_session

MOVES = {"as is": lambda x: x, "moved by 1e8": lambda x: x + F.lit(1e8), "times 1e39": lambda x: x * F.lit(1e39)}


def main() -> None:
    spark = local_session(8, "8g", "recall")
    for folder in sys.argv[1:]:
        plain, folder = folder.startswith("+"), folder.removeprefix("+")
        for name, move in list(MOVES.items())[: 1 if plain else None]:
            vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), move).alias("vec"))
            began = time.time()
            rows = N.nearest(vectors, F.col("vec_id") % 100 == 0).collect()
            took = time.time() - began
            known = N._usable(vectors).toArrow().combine_chunks()
            ids, x = known.column(0).to_numpy(), np.stack(known.column(1).to_numpy())
            x = x / np.abs(x).max() - (x / np.abs(x).max()).mean(0)
            found: dict[int, set] = {}
            for r in rows:
                found.setdefault(r["query_id"], set()).add(r["vec_id"])
            hits = 0
            for q in found:
                d = ((x - x[ids == q][0]) ** 2).sum(1)
                d[ids == q] = np.inf
                hits += len(found[q] & set(ids[np.argsort(d, kind="stable")[:10]].tolist()))
            share = np.mean([r["measured"] for r in rows if r["rank"] == 1]) / len(ids)
            print(f"{folder} {name}: {len(ids)} vectors, {len(found)} queries, recall {hits / (10 * len(found)):.4f}, measured {share:.4f} of the vectors, {took:.0f} s", flush=True)


if __name__ == "__main__":
    main()
