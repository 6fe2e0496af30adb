from matchloom.operators import profile


def test_duplicate_groups_have_all_members(spark):
    rows = [(f"name{n}", 100 * n + i) for n in range(7) for i in range(30)] + [("alone", 1)]
    found = profile.duplicate_groups(spark.createDataFrame(rows, "p_name string, p_partkey long"), "p_name", "p_partkey")
    assert sorted(map(tuple, found.collect())) == [(f"name{n}", 30, 100 * n + i) for n in range(5) for i in range(30)]
