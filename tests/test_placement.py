from shapeloom.plans import catalog

SF = "/root/testdata/sf0.001"


def test_placement_covers_all_vectors_and_vertices(spark):
    rows = catalog.queries()["k6_j3_placement_grid"](spark, SF).collect()
    assert len({r.vec_id for r in rows}) == len(rows) and max(r.vec_id for r in rows) >= 20
