"""Formats: what is written comes back, and small files by hand."""

import struct

import pytest

from weftgraph.graph import graph
from weftgraph.sources import formats as fm
from weftgraph.streaming import events


def edges(g):
    return sorted((r["src"], r["dst"], r["w"]) for r in g.edges.collect())


@pytest.fixture(scope="module")
def g(spark):
    return graph(spark.createDataFrame([(0, 1, 2.0), (1, 2, 1.5), (3, 1, 4.0)], "src long, dst long, w double"), spark.range(5), w="w").kept()


@pytest.mark.parametrize("form", ["gml", "graphml", "gexf"])
def test_nested_formats_round_trip(spark, g, tmp_path, form):
    fm.write_graph(g, f"{tmp_path}/x", form)
    joined = "\n".join(r["value"] for r in fm.text.lines(spark, f"{tmp_path}/x").orderBy("line").collect())
    (tmp_path / "one").write_text(joined)  # the parts of the folder, in order
    back = fm.read_graph(spark, f"{tmp_path}/one", form)
    assert edges(back) == edges(g) and back.nodes.count() == 5 and not back.directed


def test_nested_formats_by_hand(spark, tmp_path):
    (tmp_path / "a").write_text('graph [ directed 1 comment "x [ y" node [ id 5 label "a b" ] node [ id 7 ]\n# no\n edge [ source 7 target 5 value 2 ] ]')
    assert edges(fm.read_graph(spark, f"{tmp_path}/a", "gml")) == [(1, 0, 2.0)]
    (tmp_path / "b").write_text('<graphml><graph edgedefault="directed"><node id="n1"/><node id="n0"/><edge source="n1" target="n0"/></graph></graphml>')
    back = fm.read_graph(spark, f"{tmp_path}/b", "graphml")
    assert edges(back) == [(0, 1, 1.0)] and back.directed and not back.weighted


def test_line_formats(spark, g, tmp_path):
    (tmp_path / "k").write_text("% asym posweighted\n% 3 3 3\n1 2  1.5\n2 3 2\n1 2 9\n")
    back = fm.read_graph(spark, f"{tmp_path}/k", "konect")
    assert edges(back) == [(0, 1, 1.5), (1, 2, 2.0)] and back.directed
    (tmp_path / "m").write_text("%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 2\n1 1 5\n3 1 2.5\n")
    m, shape = fm.read_matrix_market(spark, f"{tmp_path}/m")
    assert shape == (3, 3) and sorted(map(tuple, m.collect())) == [(0, 0, 5.0), (0, 2, 2.5), (2, 0, 2.5)]
    fm.write_matrix_market(m, shape, f"{tmp_path}/mm")
    again, shape = fm.read_matrix_market(spark, f"{tmp_path}/mm")
    assert shape == (3, 3) and sorted(map(tuple, again.collect())) == sorted(map(tuple, m.collect()))
    fm.convert(spark, f"{tmp_path}/k", "konect", f"{tmp_path}/s", "snap")
    assert fm.text.lines(spark, f"{tmp_path}/s").orderBy("line").first()["value"] == "# Directed graph"
    fm.write_dot(g, f"{tmp_path}/d", spark.createDataFrame([(0, 3)], "node long, block long"))
    lines = [r["value"] for r in fm.text.lines(spark, f"{tmp_path}/d").orderBy("line").collect()]
    assert lines[0] == "graph {" and lines[-1] == "}" and '  1 -- 0 [label="2.0"];' in lines and '  0 [style=filled, colorscheme=set312, fillcolor="4"];' in lines
    with pytest.raises(ValueError):
        fm.read_graph(spark, "x", "nothing")


def test_partitions_and_covers(spark, tmp_path):
    p = spark.createDataFrame([(0, 4), (1, 2), (2, 4)], "node long, block long")
    fm.write_partition(p, f"{tmp_path}/p")
    assert sorted(map(tuple, fm.text.read_partition(spark, f"{tmp_path}/p").collect())) == [(0, 4), (1, 2), (2, 4)]
    fm.write_binary_partition(p, f"{tmp_path}/b")
    assert fm.export(spark, f"{tmp_path}/b") == struct.pack("<3I", 4, 2, 4)
    assert sorted(map(tuple, fm.read_binary_partition(spark, f"{tmp_path}/b").collect())) == [(0, 4), (1, 2), (2, 4)]
    (tmp_path / "plain").write_bytes(struct.pack("<4I", 0, 9, 3, 7))
    assert sorted(map(tuple, fm.read_binary_pairs(spark, f"{tmp_path}/plain").collect())) == [(0, 9), (3, 7)]
    fm.write_cover(p, f"{tmp_path}/c")
    assert sorted(map(tuple, fm.text.read_cover(spark, f"{tmp_path}/c").collect())) == [(0, 1), (1, 0), (2, 1)]
    (tmp_path / "e").write_text("1\t1 5 8\n2\t3\n")
    assert sorted(map(tuple, fm.read_edge_list_cover(spark, f"{tmp_path}/e").collect())) == [(0, 1), (0, 5), (0, 8), (1, 3)]


def test_binary_graphs(spark, g, tmp_path):
    data = b"".join(bytes(r["data"]) for r in fm.thrill_bytes(g).orderBy("id").collect())
    (tmp_path / "t").write_bytes(data)
    back = fm.read_graph(spark, f"{tmp_path}/t", "thrill")
    assert [e[:2] for e in edges(back)] == [e[:2] for e in edges(g)] and back.nodes.count() == 5


def test_event_files(spark, tmp_path):
    (tmp_path / "x.dgs").write_text('DGS004\ntest 0 0\nan "a"\nan b\nae ab a b weight=1\nst 1\nce ab weight=2\nst 2\nan c\nae "bc" b > c\nde ab\n')
    found, ids = fm.read_dgs(spark, f"{tmp_path}/x.dgs")
    assert {r["key"]: r["id"] for r in ids.collect()} == {"a": 0, "b": 1, "c": 2}
    rows = [(r["step"], r["type"], r["u"], r["v"], r["w"]) for r in found.orderBy("seq").collect()]
    assert rows[2] == (0, "edge_add", 0, 1, 1.0) and rows[3] == (1, "weight", 0, 1, 2.0) and rows[-1] == (2, "edge_remove", 0, 1, None)
    fm.write_dgs(found, f"{tmp_path}/y")
    again, _ = fm.read_dgs(spark, f"{tmp_path}/y")
    assert edges(events.fold(again)) == edges(events.fold(found)) == [(2, 1, 1.0)]
