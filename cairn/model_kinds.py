"""Own model kinds: Spark ML estimators that a run fits by name.

A kind is a name, a function that builds the estimator from its columns and
parameters, and the parameter names it allows. ``ModelPolicy`` accepts a
registered name like the built-in ones; the run, its log, the result payload and
the artefacts treat the fitted model like any other.

    register_model_kind("boosted", lambda columns, params: GBTRegressor(**columns, maxIter=params.get("rounds", 20)), ["rounds"], fixed_partitions=True)
    ModelPolicy("boosted", {"rounds": 40})
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

#: Names that are taken.
BUILT_IN = ("linear_regression", "random_forest")


@dataclass(frozen=True)
class ModelKind:
    name: str
    #: (featuresCol, labelCol and predictionCol by name, the policy's parameters) -> an estimator
    build: Callable[[dict[str, str], dict[str, Any]], Any]
    parameters: frozenset[str]
    #: the fit depends on how rows lie in partitions (bootstraps): they follow the rows alone
    fixed_partitions: bool = False

    def estimator(self, features_col: str, label_col: str, prediction_col: str, params: dict[str, Any]):
        columns = {"featuresCol": features_col, "labelCol": label_col, "predictionCol": prediction_col}
        made = self.build(columns, dict(params))
        for name, wanted in columns.items():
            if not (hasattr(made, "hasParam") and made.hasParam(name) and made.getOrDefault(name) == wanted):
                raise ValueError(f"model kind {self.name!r} built an estimator without {name}={wanted!r}")
        return made


_KINDS: dict[str, ModelKind] = {}


def register_model_kind(name: str, build: Callable[[dict[str, str], dict[str, Any]], Any], parameters: Iterable[str] = (),
                        fixed_partitions: bool = False) -> ModelKind:
    """Makes ``name`` a model kind; a name is taken once (registering the same function again changes nothing)."""
    if not (name or "").strip():
        raise ValueError("a model kind needs a name that is not empty")
    known = _KINDS.get(name)
    if name in BUILT_IN or (known is not None and known.build is not build):
        raise ValueError(f"a model kind called {name!r} is already registered")
    _KINDS[name] = ModelKind(name, build, frozenset(parameters), fixed_partitions)
    return _KINDS[name]


def registered(name: str) -> ModelKind | None:
    return _KINDS.get(name)


def kinds() -> tuple[str, ...]:
    """All names that a policy may ask for."""
    return (*BUILT_IN, *_KINDS)
