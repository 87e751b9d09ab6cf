"""Near pairs across tasks with the operator's own window, against a walk of the reference's rule."""

import pyarrow.parquet as pq

from tidemark.operators.cross_task import WINDOW
from tidemark.queries import NEAR, near_cross_task


def walked(path, window):
    """Each vector's latest earlier one of another task and the same label within NEAR bits."""
    groups: dict[int, list] = {}
    for row in sorted(pq.read_table(path).to_pylist(), key=lambda r: r["vec_id"]):
        bits = int("".join("1" if x > 0 else "0" for x in row["embedding"][:64]), 2)
        groups.setdefault(row["label"], []).append((f"t{row['vec_id'] % 7}", row["vec_id"] // 7, bits))
    pairs = set()
    for group in groups.values():
        assert len(group) <= window + 1, "no call falls back to bands"
        for i, (task, step, bits) in enumerate(group):
            for other, at, held in reversed(group[:i]):
                if other != task and (bits ^ held).bit_count() <= NEAR:
                    pairs.add((task, step, other, at, (bits ^ held).bit_count()))
                    break
    return pairs


def test_whole_window(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got = [tuple(r) for r in near_cross_task(spark, sf_dir).collect()]
    assert len(got) == len(set(got))
    assert set(got) == walked(f"{sf_dir}/embeddings.parquet", WINDOW)
