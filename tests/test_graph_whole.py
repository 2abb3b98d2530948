from codequarry.operators import graph


def test_paths_beyond_fifty_hops(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(53)], "source int, target int")
    got = {r.node: r.hops for r in graph.shortest_paths(e, spark.createDataFrame([(0,)], "start int")).collect()}
    assert got == {i: i for i in range(54)}
