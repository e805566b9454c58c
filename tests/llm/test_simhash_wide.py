"""Crowded files of the wide SimHash lose no link."""

from wayfind.llm import simhash_wide
from wayfind.llm.components import connected_components


def test_crowded_files_lose_no_link(spark):
    """Nine fingerprints that share one key and no other: a chain of close ones, and one that is far from all."""
    fps = [bytes([255 >> 8 - min(k, 8)] * 12 + [0] * 60) for k in range(8)] + [bytes([255] * 72)]
    nodes = spark.createDataFrame([(k, bytearray(fp), [5, *range(100 * k + 100, 100 * k + 147)]) for k, fp in enumerate(fps)], "id long, fp binary, keys array<long>")
    for crowded in (2,):
        parts = {r["node"]: r["root"] for r in connected_components(simhash_wide.link_wide(nodes, 12, crowded)).collect()}
        assert parts == {k: 0 for k in range(8)}
