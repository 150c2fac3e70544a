"""Every payment query with an oracle against DuckDB."""

import pytest

from quaylight.plans.oracles import ORACLES
from quaylight.plans.queries import QUERIES
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_only_model_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"isolation_forest", "one_class", "unsupervised_ensemble", "gbt_scores", "random_forest_scores", "logistic_scores", "shap_top_features", "graph_ablation"}
