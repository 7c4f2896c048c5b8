"""All registered queries; importing the query modules fills the catalog."""

from . import queries_explore, queries_features, queries_metrics, queries_models, queries_monitor, queries_prepare
from .catalog import ORACLES, QUERIES

MODULES = (queries_prepare, queries_features, queries_models, queries_metrics, queries_explore, queries_monitor)


def registered():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
