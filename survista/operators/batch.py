"""Several analyses at once: named, with defaults. All A/E analyses of one step share one pass over the lives.

Everything is checked before anything runs, so that a bad specification costs nothing wherever it stands.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from survista.operators.aev import Aev, aev, run_together, spec
from survista.operators.compare import compare_models
from survista.operators.covariates import Model
from survista.operators.fit import Fit, NotDisjoint, fit
from survista.operators.settings import resolve, valid_name
from survista.sources.data import ExpData

KINDS = {"aev": aev, "fit": fit, "compare_models": compare_models}
#: Arguments of which an element's own displaces a default of the other.
PAIRS = (("val_relevance", "val_distance"), ("test_mortality", "Z"))
FITS_ONLY = ("test_mortality", "Z", "tolerance", "iterations")


class Deferred:
    """An analysis to be run in a batch."""

    def __init__(self, kind: str, args: tuple, kwargs: dict):
        if kind not in KINDS:
            raise ValueError(f"{kind} cannot stand in a batch")
        self.kind, self.args, self.kwargs = kind, args, kwargs


def element(kind: str, *args, **kwargs) -> Deferred:
    """An element: the kind of analysis and its arguments but for the data."""
    return Deferred(kind, args, kwargs)


class FitFailure:
    """What a batch holds for an element that could not be fitted."""

    def __init__(self, message: str):
        self.message = message

    def __repr__(self):
        return f"FitFailure({self.message!r})"


def batch(data: ExpData, elements: dict[str, Deferred], **defaults) -> dict[str, Aev | Fit | FitFailure]:
    """Results by name. Defaults fill in what an element leaves out. A/E elements are parts of one unevaluated plan, which
    `union_of` gives as a whole."""
    ready, specs = [], []
    for name, e in elements.items():
        valid_name(name)
        if not isinstance(e, Deferred):
            raise ValueError(f"{name} is not an element(...)")
        given = dict(defaults)
        for pair in PAIRS:
            if any(p in e.kwargs for p in pair):
                for p in pair:
                    given.pop(p, None)
        if e.kind == "aev":
            given = {k: v for k, v in given.items() if k not in FITS_ONLY}
            specs.append(spec(data, *e.args, **(given | e.kwargs)))
        else:
            how = given | e.kwargs
            models = e.args[0] if e.args else how.get("models", how.get("model"))
            if not all(isinstance(m, Model) for m in (models if isinstance(models, list | tuple) else [models])):
                raise ValueError(f"{name} needs models")
            resolve(how.get("settings"), how.get("overdispersion"), how.get("time_scale"))
            if (how.get("test_mortality") is None) == (how.get("Z") is None):
                raise ValueError(f"{name} needs either test_mortality or Z")
        ready.append((name, e, given))
    shared = run_together(data, specs) if specs else None
    out, no = {}, 0
    for name, e, given in ready:
        if e.kind == "aev":
            out[name] = Aev(shared.where(F.col("no") == no).drop("no"), (shared, no))
            no += 1
            continue
        try:
            out[name] = KINDS[e.kind](data, *e.args, **(given | e.kwargs))
        except NotDisjoint as error:
            out[name] = FitFailure(str(error))
    return out


def union_of(results: dict[str, Aev]):
    """The A/E results of a batch as one frame, with the element's name; those of one batch from one pass."""
    mine = [(n, r) for n, r in results.items() if isinstance(r, Aev)]
    whole = {id(r.of[0]): r.of[0] for _, r in mine if r.of is not None}
    if len(whole) == 1 and all(r.of is not None for _, r in mine):
        (df,) = whole.values()
        names = F.create_map(*[F.lit(v) for n, r in mine for v in (r.of[1], n)])
        return df.where(F.col("no").isin([r.of[1] for _, r in mine])).select(F.try_element_at(names, F.col("no")).alias("element"), *[c for c in df.columns if c != "no"])
    out = None
    for n, r in mine:
        f = r.df.select(F.lit(n).alias("element"), "*")
        out = f if out is None else out.unionByName(f)
    return out
