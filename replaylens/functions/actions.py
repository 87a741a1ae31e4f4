"""Expressions over keys, clicks and mouse deltas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import ACTION_TAIL, MOUSE_LIMIT


def action_vector(keys="keys", lclick="lclick", rclick="rclick", dx="dx", dy="dy") -> Column:
    """Keys, clicks and mouse delta as one float array, in that order."""
    tail = F.array(*[F.col(c).cast("float") for c in (lclick, rclick, dx, dy)])
    return F.concat(F.transform(keys, lambda k: k.cast("float")), tail)


def action_layout(key_names="key_names") -> Column:
    """Names of the action vector's entries."""
    return F.concat(key_names, F.array(*[F.lit(n) for n in ACTION_TAIL]))


def key_held(key: str, keys="keys", key_names="key_names") -> Column:
    """State of one key, found by name. A name the session does not log is an error."""
    at = F.array_position(key_names, F.lit(key))
    return (F.when(at > 0, F.get(F.col(keys), (at - 1).cast("int")).cast("int"))
            .when(F.col(key_names).isNotNull(), F.raise_error(F.concat(
                F.lit(f"key '{key}' is not logged; keys are "), F.array_join(key_names, ",")))))


def key_columns(wanted: list[str], keys="keys", key_names="key_names") -> list[Column]:
    """One ``k_<name>`` column per wanted key."""
    return [key_held(k, keys, key_names).alias(f"k_{k}") for k in wanted]


def held_keys(keys="keys", key_names="key_names") -> Column:
    """Names of the held keys, in stored order."""
    pairs = F.filter(F.arrays_zip(F.col(keys).alias("v"), F.col(key_names).alias("k")),
                     lambda p: p["v"] > 0)
    return F.transform(pairs, lambda p: p["k"])


def pressed_keys(probs: str | Column, names: list[str], threshold: float) -> Column:
    """Names whose probability reaches the threshold; every key on its own."""
    probs = F.col(probs) if isinstance(probs, str) else probs
    pairs = F.transform(probs, lambda p, i: F.struct(
        p.alias("p"), F.get(F.array(*[F.lit(n) for n in names]), i).alias("k")))
    return F.transform(F.filter(pairs, lambda x: x["p"] >= threshold), lambda x: x["k"])


def mouse_step(delta: Column) -> Column:
    """A predicted delta as a whole, bounded mouse step; halves round to even."""
    return F.greatest(F.lit(-MOUSE_LIMIT), F.least(F.lit(MOUSE_LIMIT), F.bround(delta, 0))).cast("int")


def action_text(keys="keys", key_names="key_names", lclick="lclick", rclick="rclick",
                dx="dx", dy="dy") -> Column:
    """Readout such as ``keys[w+d]  click[L]  mouse(dx=+3, dy=-1)``."""
    def or_dash(text):
        return F.when(text == "", F.lit("-")).otherwise(text)
    clicks = F.concat(F.when(F.col(lclick) > 0, "L").otherwise(""),
                      F.when(F.col(rclick) > 0, "R").otherwise(""))
    # Fixed value: the layout of readouts.
    return F.format_string("keys[%s]  click[%s]  mouse(dx=%+d, dy=%+d)",
                           or_dash(F.array_join(held_keys(keys, key_names), "+")),
                           or_dash(clicks), F.col(dx), F.col(dy))
