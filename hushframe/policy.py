"""Policies: which rule, if any, a field gets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import rules
from .functions.rules import Rule
from .model import ErrorCode, Field, MaskError


@dataclass(frozen=True)
class Decision:
    """A rule, or that the field goes; neither: no opinion."""

    rule: Rule | None = None
    omit: bool = False

    def __bool__(self) -> bool:
        return self.omit or self.rule is not None


NO_OPINION, OMIT = Decision(), Decision(omit=True)


@lru_cache(maxsize=4096)
def fold(key: str) -> str:
    """A key without `_`, `-` and `.`, each letter folded by itself (the Kelvin and long s signs are k and s; ß stays)."""

    def one(c: str) -> str:
        if c in "ıİ":
            return c
        up = c.upper()
        low = (up if len(up) == 1 else c).lower()
        return low if len(low) == 1 else c

    return "".join(one(c) for c in key if c not in "_-.")


def fold_column(key: Column) -> Column:
    """fold() of a column, for keys that are compared with ASCII ones."""
    return F.lower(F.translate(key, "ſK_-.", "sk"))


class Policy:
    """decide() must depend on the field alone."""

    def decide(self, field: Field) -> Decision:
        raise NotImplementedError

    #: Folded key -> rule, where keys alone decide; None where they don't.
    keys: dict[str, Rule] | None = None


class KeyPolicy(Policy):
    """Rules by whole keys; bindings are pairs of keys and rule. Keys equal after fold() must agree."""

    def __init__(self, bindings: list[tuple[list[str], Rule]]):
        self.keys = {}
        for names, rule in bindings:
            if not isinstance(rule, Rule):
                raise MaskError(ErrorCode.INVALID_CONFIG, "binding without a rule")
            for name in names:
                key = fold(name)
                if not key or self.keys.setdefault(key, rule) != rule:
                    raise MaskError(ErrorCode.INVALID_CONFIG, f"key {name!r}")

    def decide(self, field: Field) -> Decision:
        rule = self.keys.get(fold(field.key)) if field.key else None
        return Decision(rule) if rule else NO_OPINION


class _Function(Policy):
    def __init__(self, function: Callable[[Field], Decision]):
        self.function = function

    def decide(self, field: Field) -> Decision:
        return self.function(field)


class _Chain(Policy):
    def __init__(self, policies: tuple[Policy, ...]):
        self.policies = policies
        if all(p.keys is not None for p in policies):
            self.keys = {k: r for p in reversed(policies) for k, r in p.keys.items()}

    def decide(self, field: Field) -> Decision:
        return next((d for p in self.policies if (d := p.decide(field))), NO_OPINION)


def policy_fn(function: Callable[[Field], Decision]) -> Policy:
    """A policy of one's own."""
    if not callable(function):
        raise MaskError(ErrorCode.INVALID_CONFIG, "policy")
    return _Function(function)


def chain(*policies: Policy) -> Policy:
    """The first opinion counts."""
    if not policies or not all(isinstance(p, Policy) for p in policies):
        raise MaskError(ErrorCode.INVALID_CONFIG, "empty chain")
    return _Chain(policies)


# Keys that are masked by default, by rule.
DEFAULT_KEYS = {
    "password": "password passwd passphrase pwd",
    "token": "token access_token refresh_token api_key apikey api_token secret client_secret secret_key secret_access_key aws_secret_access_key id_token private_key private_token session_id credentials auth_token otp",
    "email": "email e-mail",
    "phone": "phone phone_number mobile",
    "id": "id user_id customer_id",
    "card": "card card_number pan",
    "full": "authorization cookie set-cookie x-api-key x-api-token x-access-token x-auth-token proxy-authorization x-csrf-token cvv cvc",
}


def default_bindings() -> list[tuple[list[str], Rule]]:
    return [(keys.split(), rules.BUILT_IN[name]) for name, keys in DEFAULT_KEYS.items()]


def default_policy() -> KeyPolicy:
    return KeyPolicy(default_bindings())
