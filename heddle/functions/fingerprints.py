"""Fingerprints of experiment configurations, which are JSON texts in a column: a row per run, so few that Python may parse them."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of a configuration that a metric depends on and their types, which must stay for equal fingerprints.
PROTOCOL = {
    "data": {"dataset": str, "image_size": int, "resize_mode": str, "calibration_fraction": float},
    "model": {"checkpoint": str, "active_layers": list, "token_norm": str},
    "memory": {"sampling": str, "ratio": float, "projection_dim": int, "max_candidates": int},
    "retrieval": {"spatial_mode": str, "fixed_lambda": float, "query_chunk_size": int, "bank_chunk_size": int, "lambda_max": float, "tau_quantile": float},
    "calibration": {"mad_epsilon": float, "threshold_fit_fraction": float, "pixel_quantile": float, "pixel_image_quantile": float, "pixel_topk_fraction": float, "image_quantile": float, "clamp_min_zero": bool},
    "inference": {"gaussian_sigma": float, "image_score": str, "image_topk_fraction": float},
    "evaluation": {"compute_oracle_f1": bool},
}
#: The threshold fields of a configuration.
THRESHOLD = {"pixel_threshold_method": str, "pixel_quantile": float, "pixel_image_quantile": float, "pixel_topk_fraction": float}


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _cast(kind: type, value: object) -> object:
    return [int(v) for v in value] if kind is list else kind(value)


def metric_protocol(config: dict, with_method: bool) -> dict:
    out: dict = {"model_seed": int(config["experiment"]["seed"])}
    out |= {part: {name: _cast(kind, config[part][name]) for name, kind in fields.items()} for part, fields in PROTOCOL.items()}
    if with_method:
        out["calibration"]["pixel_threshold_method"] = str(config["calibration"]["pixel_threshold_method"])
    return out


def _over_json(project) -> object:
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else canonical(project(json.loads(t))))

    return apply


def config_fingerprint(config_json: Column) -> Column:
    """The SHA-256 of a configuration's canonical JSON, without the path that it came from."""
    return F.sha2(_over_json(lambda c: {k: v for k, v in c.items() if k != "_config_path"})(config_json), 256)


def protocol_fingerprint(config_json: Column, with_method: bool = False) -> Column:
    return F.sha2(_over_json(lambda c: metric_protocol(c, with_method))(config_json), 256)


def threshold_parameters(config_json: Column) -> Column:
    """The threshold fields of a configuration as canonical JSON."""
    return _over_json(lambda c: {k: kind(c["calibration"][k]) for k, kind in THRESHOLD.items()})(config_json)


def payload_fingerprint(payload: object) -> str:
    return hashlib.sha256(canonical(payload).encode()).hexdigest()
