"""Source registry (SRC-4, SRC-5, SRC-8) and the documented pattern example."""

import pytest

from skiff.sources import registry
from skiff.operators import select


def test_documented_pattern_example(spark):
    spec = registry.get_source("betfair")
    sel = select.selection(spark, "my-bucket", ["ADVANCED/2016/Jan/1"])
    got = [r.pattern for r in spec.build_patterns(sel).orderBy("glob_no").collect()]
    assert got == ["gs://my-bucket/ADVANCED/2016/Jan/1/*.bz2", "gs://my-bucket/ADVANCED/2016/Jan/1/**/*.bz2"]


def test_multi_extension_patterns(spark):
    spec = registry.get_source("racing_api")
    got = [r.pattern for r in spec.build_patterns(select.selection(spark, "b", ["/p/"])).orderBy("glob_no").collect()]
    assert got == ["gs://b/p/*.json", "gs://b/p/**/*.json", "gs://b/p/*.json.gz", "gs://b/p/**/*.json.gz"]


def test_registry_lookup_and_listing(spark):
    with pytest.raises(ValueError, match="nosuch"):
        registry.get_source("nosuch")
    rows = {r.id: r for r in registry.list_sources(spark).collect()}
    assert set(rows) == {"betfair", "racing_api"}
    assert rows["betfair"].enabled and not rows["racing_api"].enabled
    assert rows["racing_api"].extensions == [".json", ".json.gz"]


def test_disabled_source_cannot_be_opened():
    with pytest.raises(registry.DisabledSource):
        registry.open_source("racing_api")
    assert registry.open_source("betfair").reader is not None
