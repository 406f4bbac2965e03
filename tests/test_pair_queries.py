"""How the registered pair queries find and carry their pairs."""

from quarrymill.plans import registry


def plan(df):
    return df._jdf.queryExecution().toString()


def test_background_moves_no_vector_to_its_pairs(spark, sf_dir):
    found = plan(registry.background_top2(spark, sf_dir))
    assert "FlatMapGroupsInArrow" in found and "view1_1" not in found and "v_1" not in found


def test_enriched_pairs_meet_in_tiles(spark, sf_dir):
    found = plan(registry.pair_enrichment(spark, sf_dir))
    assert "FlatMapGroupsInArrow" in found and "earlier" not in found and found.count("band") == 0


def test_strict_components_fold_hashes_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(registry, "_components", lambda edges: edges)
    edges = registry.components_strict(spark, sf_dir)
    assert any("hash-classes" in path for path in edges.inputFiles()) and "FlatMapGroupsInArrow" in plan(edges)


def test_scene_components_find_strict_pairs_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(registry, "_components", lambda edges: edges)
    edges = registry.components_scene(spark, sf_dir)
    assert any("strict-pairs" in path for path in edges.inputFiles()) and "FlatMapGroupsInArrow" not in plan(edges)


def test_background_takes_only_the_vector_to_its_tiles(spark, sf_dir):
    found = plan(registry.background_top2(spark, sf_dir))
    assert "view1" not in found and "dot1" not in found and "sim#" not in found and "zip_with" not in found


def test_enriched_pairs_are_joined_with_no_table(spark, sf_dir):
    found = plan(registry.pair_enrichment(spark, sf_dir))
    assert "LeftOuter, (img" not in found and "deduplicate" not in found.lower() and "SortMergeJoin" not in found
