"""Value digest shared by the tests and scripts/check_oracle.py."""

import hashlib
import math

import pandas as pd


def norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<null>"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, pd.Timestamp):
        return str(v.to_pydatetime())
    if v is pd.NA:
        return "<null>"
    return str(v)


def digest(df: pd.DataFrame) -> str:
    cols = sorted(df.columns)
    rows = sorted("|".join(norm(r[c]) for c in cols) for r in df[cols].to_dict("records"))
    return hashlib.md5("\n".join(rows).encode()).hexdigest()


def frames_match(a: pd.DataFrame, b: pd.DataFrame, tol: float = 2e-6) -> bool:
    """Order-insensitive equality with a float tolerance (rounded outputs can
    land on different sides of a decimal tie in two engines)."""
    import numpy as np
    if sorted(a.columns) != sorted(b.columns) or len(a) != len(b):
        return False
    cols = sorted(a.columns)

    def key(df):
        k = pd.DataFrame({c: df[c].map(lambda v: norm(round(v, 3) if isinstance(v, float) else v)) for c in cols})
        return df.assign(_k=k.agg("|".join, axis=1)).sort_values("_k").reset_index(drop=True)

    x, y = key(a[cols]), key(b[cols])
    for c in cols:
        xa, ya = x[c].tolist(), y[c].tolist()
        for u, v in zip(xa, ya):
            if isinstance(u, float) or isinstance(v, float):
                uu = float("nan") if u is None or u is pd.NA else float(u)
                vv = float("nan") if v is None or v is pd.NA else float(v)
                if not ((np.isnan(uu) and np.isnan(vv)) or abs(uu - vv) <= tol * max(1.0, abs(uu))):
                    return False
            elif norm(u) != norm(v):
                return False
    return True
