"""Default parameters and fixed values of the data model."""

from __future__ import annotations

# They decide the content of the token tables.
BIRTH_CODE = "MEDS_BIRTH"
TYPE_PAD, TYPE_NAME, TYPE_VALUE, TYPE_CLS, TYPE_SEP = 0, 2, 3, 5, 6
TOKEN_PAD, TOKEN_UNK, TOKEN_CLS, TOKEN_SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
SPECIAL_TOKEN_IDS = {TOKEN_PAD: 0, TOKEN_UNK: 100, TOKEN_CLS: 101, TOKEN_SEP: 102}
FIRST_WORD_ID = 104
VOCABULARY_SIZE = 28996
POINT_PLACE = 5
MAX_EVENT_TOKENS = 128
NUM_TYPES = 8
NUM_PLACES = 100

# The key column of each legacy stay table.
STAY_KEYS = {
    "mimiciv": "stay_id",
    "eicu": "patientunitstayid",
    "umcdb": "admissionid",
    "hirid": "patientid",
}

# Task families by a pattern on the task name, tried in this order.
SINGLE_TASK = "meds_single_task"
TASK_FAMILIES = (
    ("mortality|readmission|los", "binary", 1),
    ("diagnosis", "multilabel", 17),
    ("creatinine|platelets", "multiclass", 5),
    ("wbc|bicarbonate|sodium", "multiclass", 3),
    ("hb", "multiclass", 4),
)
DIAGNOSIS_CLASSES = {"umcdb": 13}

# Defaults of the keyword arguments.
MAX_SEQ_LEN = 512
ENCODE_CHUNK = 1024
MAX_RETRIEVE_LEN = 128
PAD_CHUNK = 128
MEMORY_CHUNK, MEMORY_SIZE = 512, 10
BATCH_SIZE = 8
DEBUG_SAMPLES = 3000
PATIENCE = 3
WEIGHT_EPS = 1e-10
