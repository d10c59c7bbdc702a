"""Descriptors, names, literals and grid algebra."""

import pytest

from gridloom.functions.descriptors import DescriptorError, expand, parse_dataset, parse_descriptor, parse_literal, parse_raster, unique_names
from gridloom.functions.grid import Box, Grid, IncompatibleGrids, common_grid


def test_descriptors():
    d = parse_descriptor("x=weighted_mean(v, w, default_weight=0 , q = 1)")
    assert (d.name, d.stat, d.values, d.weights, d.args) == ("x", "weighted_mean", "v", "w", {"default_weight": "0", "q": "1"})
    assert str(d) == "x=weighted_mean(v,w,default_weight=0,q=1)"
    assert parse_descriptor("mean").values == "" and parse_descriptor("mean(t-1)").values == "t-1"
    for bad in ("", "()", "mean(", "mean()", "mean(a", "mean(a,b,c)", "mean(q=1,a)", "mean(q=1,q=2)", "mean(q=1=2)", "mean(a,,b)", "mean(a)x"):
        with pytest.raises(DescriptorError):
            parse_descriptor(bad)


def test_files():
    assert parse_dataset("a.gpkg[roads]") == ("a.gpkg", "roads") and parse_dataset("a.gpkg") == ("a.gpkg", "0")
    assert parse_raster("t:x.tif[3]") == ("t", "x.tif", 3) and parse_raster("x.tif") == ("", "x.tif", 0)
    assert parse_raster("land[2]:x.tif") == ("land[2]", "x.tif", 0)


@pytest.mark.parametrize("ops, values, weights, names", [
    (["mean", "variety"], ["v"], [], ["mean", "variety"]),
    (["weighted_mean", "variety"], ["v"], ["w"], ["weighted_mean", "variety"]),
    (["mean"], ["a", "b"], [], ["a_mean", "b_mean"]),
    (["weighted_mean", "variety"], ["a", "b"], ["w"], ["a_w_weighted_mean", "b_w_weighted_mean", "a_variety", "b_variety"]),
    (["s=mean(a)", "variety"], ["a", "b"], [], ["s", "a_variety", "b_variety"]),
    (["weighted_mean(a,w)"], ["a"], ["w"], ["a_weighted_mean"]),
    (["weighted_mean"], ["a"], ["w", "x"], ["a_w_weighted_mean", "a_x_weighted_mean"]),
    (["mean"], ["a"], ["w", "x"], ["a_mean"]),
])
def test_names(ops, values, weights, names):
    assert [r.name for r in expand(ops, values, weights)] == names


def test_binding_errors():
    for ops, v, w in ((["mean(z)"], ["a"], []), (["weighted_mean"], ["a"], []), (["mean"], [], []), (["weighted_mean"], ["a", "b"], ["w", "x", "y"]), (["weighted_mean(a,z)"], ["a"], ["w"])):
        with pytest.raises(DescriptorError):
            expand(ops, v, w)
    with pytest.raises(DescriptorError, match="not unique"):
        unique_names(["a", "a"])


def test_literals():
    assert parse_literal("12", "uint8") == 12 and parse_literal("-3.5", "float64") == -3.5 and parse_literal("YES", "bool") is True
    assert parse_literal(str(2**63 - 1), "int64") == 2**63 - 1
    for text, kind in (("256", "uint8"), ("-1", "uint16"), ("x", "int32"), ("1.5", "int32"), ("maybe", "bool"), ("1x", "float64")):
        with pytest.raises(DescriptorError):
            parse_literal(text, kind)


def test_grid():
    g = Grid(0, 0, 10, 5, 1, 0.5)
    assert (g.rows, g.cols, g.cell(0, 5), g.cell(10, 0), g.row(4.5), g.column(3)) == (10, 10, 0, 99, 1, 3)
    assert g.x_of(0) == 0.5 and g.y_of(0) == 4.75
    c = g.crop(Box(2.5, 1.2, 4.5, 3.3))
    assert (c.xmin, c.xmax, c.ymin, c.ymax) == (2, 5, 1, 3.5)
    blocks = list(g.subdivide(25))
    assert [b.rows for b in blocks] == [2] * 5 and sum(b.size for b in blocks) == 100
    assert len(list(Grid(0, 0, 1440, 2, 1, 1).subdivide(1000))) == 4
    assert Grid.from_geotransform((0, 1, 0, 3, 0, -1), 3, 4).box == Box(0, 0, 4, 3)
    with pytest.raises(ValueError, match="Rotated"):
        Grid.from_geotransform((0, 1, 0.1, 3, 0, -1), 3, 4)


def test_common_grid():
    a, b = Grid(0, 0, 6, 6, 1, 1), Grid(2, 2, 10, 10, 2, 2)
    assert common_grid([a, b]) == Grid(0, 0, 10, 10, 1, 1) and a.overlap(b) == Grid(2, 2, 6, 6, 1, 1)
    assert b.ratio(a) == (2, 2)
    for other in (Grid(0, 0, 6, 6, 1.5, 1.5), Grid(0.5, 0, 6.5, 6, 1, 1)):
        assert not a.compatible(other)
        with pytest.raises(IncompatibleGrids):
            a.common(other)
    assert a.compatible(Grid(1e-5, 0, 6 + 1e-5, 6, 1, 1), 1e-3)
