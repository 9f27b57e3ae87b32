"""Default configuration.  Jobs take a plain dict; nothing reads globals."""

from __future__ import annotations

import copy

# The default hierarchical bin grid ({interval end: bin size},
# in order; "end" = open until the trajectory end), the temporal holdout date,
# the target and the wide-dataset static columns.
DEFAULT_CONFIG: dict = {
    "target": "DECEASED_90d",
    "bin_intervals": {
        "3h": "5min",
        "6h": "10min",
        "12h": "15min",
        "24h": "30min",
        "72h": "1h",
        "14D": "6h",
        "end": "1D",
    },
    "bin_freq_include": None,
    "holdout_type": "temporal",
    "holdout_split_date": "2023-01-01",
    "holdout_fraction": 0.2,
    "seed": 2024,
    "concepts": ["Labsvar", "Medicin"],
    "agg_func": {},
    "drop_features": {},
    "dataset": {
        "id_col": "PID",
        "num_cols": ["AGE", "HEIGHT", "WEIGHT", "ASMT_CHARLSON"],
        "cat_cols": [
            "SEX", "FIRST_HOSPITAL",
            "CHAR_mi", "CHAR_chf", "CHAR_pvd", "CHAR_cevd", "CHAR_dementia",
            "CHAR_cpd", "CHAR_rheumd", "CHAR_pud", "CHAR_mld", "CHAR_diab",
            "CHAR_diabwc", "CHAR_hp", "CHAR_rend", "CHAR_canc", "CHAR_msld",
            "CHAR_metacanc", "CHAR_aids",
        ],
        "ts_cat_names": [],
        "ts_categorical_multi_label": [],
    },
}


def default_config(**overrides) -> dict:
    cfg = copy.deepcopy(DEFAULT_CONFIG)
    cfg.update(overrides)
    return cfg
