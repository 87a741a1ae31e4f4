"""Fixed values of the recording format and of its reports.

Everything here must equal the recorded format or the published report rules,
so it is stated plainly in one place.
"""

# Logged keys, in stored column order. Files carry their own key_names; this
# list is only the default for generated data.
KEY_NAMES = ["w", "a", "s", "d", "space", "ctrl", "shift", "1", "2", "3", "r"]
ACTION_TAIL = ["lclick", "rclick", "dx", "dy"]
MOVEMENT_KEYS = ["w", "a", "s", "d", "shift", "space"]
PROBE_KEYS = ["w", "a", "s", "d"]
RARE_KEYS = ["a", "s", "d", "space"]

# Per-frame arrays.
MANDATORY_ARRAYS = ["frames", "timestamps", "keys", "lclick", "rclick", "dx", "dy"]
OPTIONAL_ARRAYS = ["radar", "alive", "round_phase", "health", "active_weapon",
                   "ammo_clip", "ammo_reserve"]
SUPPORTED_VERSIONS = [1, 2, 3, 4, 5]

# Image geometry: height, width; crops are (top, left, height, width).
FRAME_HW = (150, 270)
RADAR_HW = (128, 128)
CENTRE_CROP = (27, 55, 96, 160)
PROBE_SIZE = 32

# Split.
HOLDOUT_FRACTION = 0.20
PROBE_HOLDOUT_FRACTION = 0.4
HASH_BUCKETS = 1000

# State columns: stored widths and "absent" values. 0 is a real value.
PHASE_NONE, PHASE_WIDTH = "?", 16
WEAPON_NONE, WEAPON_WIDTH = "", 24
AMMO_NONE = -1
HEALTH_NONE = 0
FREEZETIME = "freezetime"

# Recording loop.
LOOP_FPS = 15
CHUNK_FRAMES = 1800
LONG_GAP_FACTOR = 1.8
STALL_FACTOR = 3.0
CONTACT_GRACE_S = 15.0
MOUSE_LIMIT = 600

# Windows.
WINDOW_FRAMES = 8

# Blank-frame cut.
MASK_VERSION = 1
OTSU_BINS = 256
REPORT_BINS = 12
MODE_GAP_DECADES = 1.5

# Probe and model verdicts.
MIN_PROBE_FRAMES = 20_000
MIN_PROBE_SESSIONS = 3
BROKEN_LIFT = -0.05
SIGNAL_LIFT = 0.03
PROBE_L2 = 5.0
FEATURE_STD_FLOOR = 1e-2
MIN_TRAIN_WINDOWS = 15_000
MIN_TRAIN_SESSIONS = 3
LOOK_STD_FLOOR = 1.0
PRESS_THRESHOLD = 0.4
COLLAPSE_RATIO = 0.25

# Scripted-motion check.
SYNC_DIRECTION_SHARE = 0.8
SYNC_TOLERANCE_FRAMES = 22

# Report labels by format version.
KIND_LABELS = {
    1: "v1 single file",
    2: "v2 session folder (FPV only)",
    3: "v3 session folder (FPV + radar)",
    4: "v4 session folder (FPV + radar + GSI alive)",
    5: "v5 session folder (FPV + radar + GSI alive + state features)",
}
