"""Outlines of masks drawn by hand."""

import pytest

from skerry.operators import outline

MASKS = {
    "one": ["#"], "bar": ["####"], "hole": ["####", "#..#", "####"], "corner": ["#.", ".#"], "ring in ring": ["#####", "#...#", "#.#.#", "#...#", "#####"],
    "hole at a corner": ["####", "##.#", "#.##", "####"], "none": ["..", ".."], "long": ["#" * 40, "#" + "." * 39, "#" * 40],
}


def walked(mask):
    """(edges, area) of each ring by walking along it."""
    cells = {(r, c) for r, line in enumerate(mask) for c, x in enumerate(line) if x == "#"}
    edges = {}
    for r, c in cells:
        for d, ((nr, nc), (a, b), (y, x)) in enumerate([((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0))]):
            if (r + nr, c + nc) not in cells:
                edges.setdefault((r + a, c + b), {})[d] = (r + y, c + x)
    out = []
    while any(edges.values()):
        at = min(k for k, v in edges.items() if v)
        d = min(edges[at])
        n, area = 0, 0
        while d is not None:
            to = edges[at].pop(d)
            n, area = n + 1, area + at[1] * to[0] - to[1] * at[0]
            at, d = to, next((t % 4 for t in (d + 1, d, d + 3) if t % 4 in edges.get(to, {})), None)
        out.append((n, area // 2))
    return sorted(out)


@pytest.mark.parametrize("name", MASKS)
def test_rings(spark, name):
    mask = MASKS[name]
    cells = [(r, c) for r, line in enumerate(mask) for c, x in enumerate(line) if x == "#"]
    df = spark.createDataFrame(cells, "row int, col int")
    edges = outline.rings(df)
    figures = [(r.n_edges, r.area) for r in outline.ring_figures(edges).collect()]
    assert sorted(figures) == walked(mask) and sum(a for _, a in figures) == len(cells)
    by_ring = {}
    for r in edges.collect():
        by_ring.setdefault(r.ring, []).append(r)
    for rows in by_ring.values():
        rows.sort(key=lambda r: r.pos)
        assert [r.pos for r in rows] == list(range(len(rows)))
        assert all((a.y2, a.x2) == (b.y1, b.x1) for a, b in zip(rows, rows[1:] + rows[:1], strict=True))
