"""Model files: the format is known by its first bytes, and by the suffix when writing."""

from __future__ import annotations

import json

from ..errors import IncompatibleModel
from ..model import Model
from . import lightgbm_text, ubjson, xgboost_json


def loads(raw: bytes) -> Model:
    """A model of this library's JSON, of XGBoost's JSON or UBJSON, or of LightGBM's text."""
    if raw[:1] == b"{" and raw[1:2] not in (b"L", b"l", b"I", b"i", b"U", b"#", b"$"):
        text = raw.decode()
        return Model.from_json(text) if "format" in json.loads(text) else xgboost_json.read(text)
    if raw[:1] == b"{":
        return xgboost_json.read(ubjson.loads(raw))
    if raw[:4].strip() == b"tree":
        return lightgbm_text.read(raw.decode())
    raise IncompatibleModel("the format of the model isn't known")


def dumps(model: Model, suffix: str = "json") -> bytes:
    """As ``json`` (this library's), ``xgb.json`` or ``ubj``."""
    if suffix == "json":
        return model.to_json().encode()
    if suffix in ("xgb.json", "ubj"):
        text = xgboost_json.write(model)
        return text.encode() if suffix == "xgb.json" else ubjson.dumps(json.loads(text))
    raise IncompatibleModel(f"models aren't written as {suffix!r}")
