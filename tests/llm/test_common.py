from pathlib import Path

import numpy as np
import pytest

from paperloom.llm.common import Workspace, components


def falling(n):
    """A path from the least node to the greatest and down again."""
    return [0, *range(n - 1, 0, -1)]


@pytest.mark.parametrize("order", [falling(1000), np.random.default_rng(3).permutation(20_000).tolist()], ids=["falling", "random"])
def test_long_paths_settle(spark, order):
    edges = [(a, b, "x") for a, b in zip(order, order[1:], strict=False)]
    edges += [(b, a, "x") for a, b, _ in edges[:50]] + [(7, 7, "x")]
    top = len(order)
    edges += [(top + 2, top + 1, "x"), (top + 2, top + 3, "x"), (top + 3, top + 1, "x")]
    found = components(Workspace(spark, "paths"), spark.createDataFrame(edges, "u long, v long, component string"))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == dict.fromkeys(range(top), 0) | dict.fromkeys(range(top + 1, top + 4), top + 1)


def test_no_edges(spark):
    assert components(Workspace(spark, "none"), spark.createDataFrame([(3, 3)], "u long, v long")).count() == 0


def test_tables_are_written_without_checksum_files(spark):
    """Hadoop's usual local file system starts ``chmod`` for each of them, besides the one for the file itself."""
    written = Workspace(spark, "plain").write(spark.range(100).repartition(3), "rows")
    files = [p.name for p in Path(written._paperloom_path.removeprefix("file://").removeprefix("file:")).iterdir()]
    assert written.count() == 100 and len([x for x in files if x.startswith("part-")]) == 3 and not [x for x in files if x.endswith(".crc")], files
