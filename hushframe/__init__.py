"""Fail-closed masking of sensitive data on Spark DataFrames."""

from .masker import Masker
from .model import ErrorCode, Field, Kind, MaskConfig, MaskError, Source
from .policy import NO_OPINION, OMIT, Decision, KeyPolicy, chain, default_bindings, default_policy, policy_fn

__all__ = ["Masker", "MaskConfig", "MaskError", "ErrorCode", "Field", "Kind", "Source", "Decision", "NO_OPINION", "OMIT", "KeyPolicy", "chain", "policy_fn", "default_policy", "default_bindings"]
