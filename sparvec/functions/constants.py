"""Fixed values of the quantiser: the codebooks, the seed stream and the file format."""

from __future__ import annotations

import numpy as np

# Centroids and decision boundaries of the 4, 5 and 6-bit codebooks, which must equal the published ones.
CENTROIDS_4 = (
    -1.996112, -1.512225, -1.172563, -0.887568, -0.632509, -0.395530, -0.169891, 0.049892, 0.269673, 0.495312,
    0.732291, 0.987350, 1.272345, 1.612007, 2.095894, 2.724265,
)
BOUNDARIES_4 = (
    -1.751289, -1.340438, -1.026996, -0.756128, -0.509062, -0.276322, -0.056279, 0.164289, 0.391029, 0.626095,
    0.868960, 1.125026, 1.413956, 1.764827, 2.238297,
)
CENTROIDS_5 = (
    -3.2641168, -2.6949832, -2.321901, -2.0330853, -1.7916883, -1.5806495, -1.3905898, -1.2158026, -1.0524858,
    -0.89793956, -0.7501299, -0.6074978, -0.4687885, -0.33291993, -0.19900484, -0.06620281, 0.06625264, 0.19905461,
    0.33296943, 0.46883777, 0.60757166, 0.75022924, 0.8980622, 1.052632, 1.2159506, 1.3907394, 1.5808226, 1.7919079,
    2.0333521, 2.3222392, 2.6954327, 3.2648566,
)
BOUNDARIES_5 = (
    -2.9795978, -2.5084915, -2.177543, -1.9124366, -1.6862187, -1.4856696, -1.3032461, -1.1341941, -0.97524965,
    -0.8240596, -0.67883897, -0.5381553, -0.40085423, -0.2659624, -0.13260382, 0.000024914742, 0.13265362, 0.266012,
    0.40090358, 0.5382047, 0.6789125, 0.82418275, 0.975397, 1.1343412, 1.3033949, 1.4858308, 1.6864152, 1.9126797,
    2.177845, 2.508878, 2.980162,
)
CENTROIDS_6 = (
    -3.8273482, -3.333197, -3.0166795, -2.7765143, -2.5793982, -2.41001, -2.260009, -2.124298, -1.9995066, -1.8833042,
    -1.7739713, -1.6702707, -1.571215, -1.4760238, -1.3840784, -1.2948383, -1.207906, -1.1230142, -1.0398592,
    -0.9581757, -0.87773234, -0.7983605, -0.7199343, -0.6422799, -0.5652983, -0.48888877, -0.41292742, -0.33736518,
    -0.26210162, -0.1870626, -0.11217268, -0.037357662, 0.037407417, 0.11222233, 0.1871122, 0.26215115, 0.33741492,
    0.412977, 0.48893812, 0.5653473, 0.64232975, 0.71998423, 0.7984106, 0.8777821, 0.9582232, 1.0399102, 1.1230648,
    1.2079563, 1.2948877, 1.384128, 1.4760972, 1.5713139, 1.6703697, 1.7740716, 1.8834057, 1.9996046, 2.1243992,
    2.2601078, 2.4101071, 2.5794992, 2.7766082, 3.016757, 3.3332598, 3.827421,
)
BOUNDARIES_6 = (
    -3.580496, -3.1751587, -2.8968368, -2.6782057, -2.4949536, -2.335259, -2.192403, -2.0621655, -1.9416802,
    -1.8289125, -1.7223959, -1.6210177, -1.5238943, -1.4303128, -1.3397081, -1.2516222, -1.1656973, -1.0816617,
    -0.9992423, -0.91816604, -0.8382337, -0.75930965, -0.6812571, -0.6039391, -0.5272308, -0.4510203, -0.37523368,
    -0.29980838, -0.22464456, -0.14965503, -0.07479018, 0.000024879351, 0.07483988, 0.14970465, 0.2246941, 0.29985797,
    0.37528333, 0.4510699, 0.52728003, 0.6039884, 0.68130684, 0.75935954, 0.8382834, 0.9182147, 0.9992916, 1.0817122,
    1.1657475, 1.2516719, 1.3397577, 1.4303625, 1.5239555, 1.6211035, 1.7224953, 1.8290132, 1.9417915, 2.06229,
    2.1925168, 2.3353572, 2.4950526, 2.678303, 2.8969312, 3.1752489, 3.580552,
)

CENTROIDS = {4: CENTROIDS_4, 5: CENTROIDS_5, 6: CENTROIDS_6}
BOUNDARIES = {4: BOUNDARIES_4, 5: BOUNDARIES_5, 6: BOUNDARIES_6}

# The seed stream (a 64-bit xorshift with a multiplier) and what stands for a zero seed.
SEED_FOR_ZERO = 0x9E3779B97F4A7C15
STREAM_MULTIPLIER = 0x2545F4914F6CDD1D
STREAM_SHIFTS = (12, 25, 27)

# Floors below which squared norms and residual powers don't go.
FLOOR = 1e-12

# The file format.
MAGIC = b"VECQ"
VERSIONS = {"1": 1, "1.1": 257, "1.2": 258, "1.3": 259, "1.4": 260, "1.5": 261}


def levels(bits: int) -> int:
    """Number of codes of a width."""
    return len(centroids(bits))


def centroids(bits: int) -> np.ndarray:
    if bits not in CENTROIDS:
        raise ValueError(f"bits must be 4, 5 or 6, not {bits}")
    return np.array(CENTROIDS[bits], np.float32)


def boundaries(bits: int) -> np.ndarray:
    if bits not in BOUNDARIES:
        raise ValueError(f"bits must be 4, 5 or 6, not {bits}")
    return np.array(BOUNDARIES[bits], np.float32)
