"""Pipelines and unions of operators over lazy frames."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _named(ops) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    for op in ops:
        base, names = type(op).__name__.lower(), [n for n, _ in out]
        out.append((base if base not in names else next(f"{base}_{i}" for i in range(1, len(ops) + 1) if f"{base}_{i}" not in names), op))
    return out


class _Composite:
    def _parts(self):
        raise NotImplementedError

    def get_params(self):
        return {"steps": self._parts()} | {f"{n}__{k}": v for n, op in self._parts() for k, v in op.get_params().items()}

    def set_params(self, **params):
        parts = dict(self._parts())
        for k, v in params.items():
            name, _, param = k.partition("__")
            if name not in parts or not param:
                raise ValueError(f"no parameter {k!r}")
            parts[name].set_params(**{param: v})
        return self


class Pipeline(_Composite):
    """Each step but the last transforms; a step's transform is a projection, so Catalyst fuses the chain."""

    def __init__(self, steps):
        names = [n for n, _ in steps]
        if len(set(names)) < len(names):
            raise ValueError("step names must be unique")
        for n, op in steps[:-1]:
            if not (hasattr(op, "fit") and hasattr(op, "transform")):
                raise TypeError(f"step {n!r} must have fit and transform")
        self.steps = steps

    def _parts(self):
        return self.steps

    @property
    def named_steps(self):
        return dict(self.steps)

    def __getitem__(self, i):
        return self.named_steps[i] if isinstance(i, str) else self.steps[i][1]

    @property
    def last(self):
        return self.steps[-1][1]

    @property
    def kind(self):
        return getattr(self.last, "kind", "transformer")

    @property
    def label(self):
        return self.last.label

    def clone(self):
        return Pipeline([(n, op.clone()) for n, op in self.steps])

    def _before(self, df: DataFrame) -> DataFrame:
        for _, op in self.steps[:-1]:
            df = op.transform(df)
        return df

    def fit(self, df):
        for _, op in self.steps[:-1]:
            df = op.fit(df).transform(df)
        self.last.fit(df)
        return self

    def transform(self, df):
        return self.last.transform(self._before(df))

    def fit_transform(self, df):
        return self.fit(df).transform(df)

    def predict(self, df):
        return self.last.predict(self._before(df))

    def predict_proba(self, df):
        return self.last.predict_proba(self._before(df))

    def predict_log_proba(self, df):
        return self.last.predict_log_proba(self._before(df))

    def decision_function(self, df):
        return self.last.decision_function(self._before(df))

    def score(self, df):
        return self.last.score(self._before(df))


def make_pipeline(*steps) -> Pipeline:
    return Pipeline(_named(steps))


class FeatureUnion(_Composite):
    """Every transformer's outputs beside one another on the same frame, prefixed `name__` and weighted: no join."""

    def __init__(self, transformer_list, weights=None):
        self.transformer_list, self.weights = transformer_list, weights or {}

    def _parts(self):
        return self.transformer_list

    @property
    def named_transformers(self):
        return dict(self.transformer_list)

    def clone(self):
        return FeatureUnion([(n, op.clone()) for n, op in self.transformer_list], copy.copy(self.weights))

    def fit(self, df):
        for _, op in self.transformer_list:
            op.fit(df)
        return self

    def transform(self, df):
        for name, op in self.transformer_list:
            kept = {f: F.col(f) for f in op.features}
            own = df.withColumns({f"_was_{f}": c for f, c in kept.items()})
            done = op.transform(own)
            made = [c for c in done.columns if c not in own.columns] or [f for f in op.features if f in done.columns]
            done = done.withColumns({f"{name}__{c}": F.col(c) * self.weights.get(name, 1.0) for c in made})
            df = done.select(*(F.col(f"_was_{c}").alias(c) if c in kept else F.col(c) for c in df.columns), *(f"{name}__{c}" for c in made))
        return df

    def fit_transform(self, df):
        return self.fit(df).transform(df)


def make_union(*transformers, weights=None) -> FeatureUnion:
    return FeatureUnion(_named(transformers), weights)
