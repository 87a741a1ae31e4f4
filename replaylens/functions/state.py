"""Expressions over game state: stored columns and JSON state payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (AMMO_NONE, HEALTH_NONE, KIND_LABELS, PHASE_NONE, PHASE_WIDTH,
                            WEAPON_NONE, WEAPON_WIDTH)

WEAPON = "STRUCT<name: STRING, state: STRING, ammo_clip: INT, ammo_reserve: INT>"
PAYLOAD_SCHEMA = (
    "STRUCT<provider: STRUCT<steamid: STRING>, "
    "player: STRUCT<steamid: STRING, activity: STRING, observer_slot: INT, "
    f"state: MAP<STRING, STRING>, weapons: MAP<STRING, {WEAPON}>>, "
    "round: STRUCT<phase: STRING>, map: STRUCT<phase: STRING>, auth: STRUCT<token: STRING>>")



def payload_of(payload: Column) -> Column:
    """A VARIANT payload as PAYLOAD_SCHEMA, field by field: what is absent or of another kind is null."""
    def read(variant, path: str, kind: str) -> Column:
        return F.try_variant_get(variant, path, kind)

    def weapon(name: Column, w: Column) -> Column:
        return F.struct(read(w, "$.name", "string").alias("name"), read(w, "$.state", "string").alias("state"),
                        read(w, "$.ammo_clip", "int").alias("ammo_clip"),
                        read(w, "$.ammo_reserve", "int").alias("ammo_reserve"))

    def one(path: str, name: str, kind: str = "string") -> Column:
        return read(payload, path, kind).alias(name)
    player = F.struct(one("$.player.steamid", "steamid"), one("$.player.activity", "activity"),
                      one("$.player.observer_slot", "observer_slot", "int"),
                      one("$.player.state", "state", "map<string, string>"),
                      F.transform_values(read(payload, "$.player.weapons", "map<string, variant>"), weapon).alias("weapons"))
    return F.struct(F.struct(one("$.provider.steamid", "steamid")).alias("provider"), player.alias("player"),
                    F.struct(one("$.round.phase", "phase")).alias("round"),
                    F.struct(one("$.map.phase", "phase")).alias("map"),
                    F.struct(one("$.auth.token", "token")).alias("auth"))


STATE_FIELDS = ["has_local_state", "spectating", "own_pov", "health", "alive", "round_phase",
                "map_phase", "activity", "observer_slot", "active_weapon", "ammo_clip",
                "ammo_reserve", "steamid", "player_steamid"]


def extract_state(payload: str = "payload") -> Column:
    """The 14 state fields of one payload.

    The payload is our own view unless both ids are present and differ; ``alive``
    needs our own view and health above 0, and is null without a health value.
    An empty player state counts as none.
    """
    player = F.col(f"{payload}.player")
    ours, theirs = F.col(f"{payload}.provider.steamid"), player["steamid"]
    health = F.try_element_at(player["state"], F.lit("health")).try_cast("int")
    own = F.when(ours.isNotNull() & theirs.isNotNull(), ours == theirs).otherwise(F.lit(True))
    active = F.get(F.filter(F.map_values(player["weapons"]), lambda w: w["state"] == "active"), 0)
    return F.struct(
        (F.coalesce(F.size(player["state"]), F.lit(0)) > 0).alias("has_local_state"),
        (~own).alias("spectating"), own.alias("own_pov"), health.alias("health"),
        F.when(health.isNotNull(), own & (health > 0)).alias("alive"),
        F.col(f"{payload}.round.phase").alias("round_phase"),
        F.col(f"{payload}.map.phase").alias("map_phase"),
        player["activity"].alias("activity"), player["observer_slot"].alias("observer_slot"),
        active["name"].alias("active_weapon"), active["ammo_clip"].alias("ammo_clip"),
        active["ammo_reserve"].alias("ammo_reserve"),
        ours.alias("steamid"), theirs.alias("player_steamid"))


def _text(value: Column, none: str, width: int) -> Column:
    return F.substring(F.coalesce(F.when(value != "", value), F.lit(none)), 1, width)


def stored_state(state: str = "state") -> list[Column]:
    """State as frames store it: absent values become their sentinels."""
    s = F.col(state)
    return [
        F.coalesce(s["alive"], F.lit(False)).cast("tinyint").alias("alive"),
        _text(s["round_phase"], PHASE_NONE, PHASE_WIDTH).alias("round_phase"),
        F.coalesce(s["health"], F.lit(HEALTH_NONE)).cast("smallint").alias("health"),
        _text(s["active_weapon"], WEAPON_NONE, WEAPON_WIDTH).alias("active_weapon"),
        F.coalesce(s["ammo_clip"], F.lit(AMMO_NONE)).cast("smallint").alias("ammo_clip"),
        F.coalesce(s["ammo_reserve"], F.lit(AMMO_NONE)).cast("smallint").alias("ammo_reserve"),
    ]


def state_features() -> list[Column]:
    """Model inputs: health, clip and reserve as floats with sentinels kept, and the weapon.

    All are null for frames recorded before state was stored.
    """
    known = F.col("health").isNotNull()
    return [F.col(c).cast("float").alias(f"f_{c}") for c in ("health", "ammo_clip", "ammo_reserve")] + [
        F.when(known, F.coalesce("active_weapon", F.lit(WEAPON_NONE))).alias("f_weapon")]


def life_label() -> Column:
    """ALIVE, "dead / spectating", or null where no flag was recorded."""
    return F.when(F.col("alive").isNull(), F.lit(None).cast("string")).when(
        F.col("alive") > 0, "ALIVE").otherwise("dead / spectating")


def state_text() -> Column:
    """State readout; shows only what the recording's version stored."""
    clip = F.col("ammo_clip")
    parts = [
        F.when(F.col("alive") > 0, "GSI: ALIVE").otherwise("GSI: dead"),
        F.concat(F.lit("  round["), F.col("round_phase"), F.lit("]")),
        F.format_string("  hp=%3d", F.col("health")),
        F.concat(F.lit("  wpn["), F.when(F.col("active_weapon") == "", "-").otherwise(
            F.col("active_weapon")), F.lit("]")),
        F.concat(F.lit("  ammo["), F.when(clip >= 0, F.concat_ws(
            "/", clip.cast("string"), F.col("ammo_reserve").cast("string"))).otherwise("-"), F.lit("]")),
    ]
    present = [F.col("alive"), F.col("round_phase"), F.col("health"), F.col("active_weapon"),
               F.when(F.col("ammo_reserve").isNotNull(), clip)]
    shown = [F.when(p.isNotNull(), text) for p, text in zip(present, parts)]
    return F.when(F.col("alive").isNotNull(), F.concat_ws("", *shown))


def kind_label(version: Column, is_folder: Column) -> Column:
    """Human label of a format version."""
    noun = F.when(is_folder, "folder").otherwise("file")
    label = F.when(version.isNull(), F.concat(F.lit("unknown-schema "), noun))
    for v, text in KIND_LABELS.items():
        label = label.when(version == v, text)
    return label.otherwise(F.concat(F.lit("schema-v"), version.cast("string"), F.lit(" "), noun,
                                    F.lit(" (newer than this tool knows)")))
