"""Golden count tables (fixed values copied from the published result tables)."""

# Test-split cluster x type counts of the published k=30 run.
TYPES = ["backdoor", "ddos", "dos", "injection", "mitm", "normal", "password", "ransomware",
         "scanning", "xss"]
CLUSTER_TYPE_COUNTS = {
    0: [0, 0, 2, 0, 40, 39, 13, 0, 3062, 532],
    1: [0, 0, 0, 0, 0, 2, 0, 0, 0, 0],
    2: [0, 0, 0, 0, 0, 448, 0, 0, 0, 0],
    4: [2, 3, 0, 4, 7, 0, 4, 32, 54, 316],
    5: [0, 0, 0, 0, 0, 277, 0, 0, 0, 0],
    8: [0, 0, 0, 10, 4, 57, 0, 14, 0, 0],
    9: [0, 0, 2, 0, 0, 0, 108, 0, 0, 0],
    10: [72, 0, 0, 0, 0, 0, 0, 0, 48, 7],
    11: [0, 0, 0, 0, 0, 9, 0, 0, 0, 3031],
    12: [0, 11, 125, 0, 29, 32, 0, 0, 0, 0],
    14: [0, 0, 0, 0, 0, 1166, 0, 0, 0, 0],
    15: [0, 0, 0, 0, 0, 0, 0, 0, 0, 179],
    16: [0, 0, 0, 0, 0, 17, 0, 0, 0, 0],
    17: [0, 5, 0, 1, 0, 1, 0, 0, 0, 7],
    20: [0, 0, 2, 0, 0, 0, 0, 0, 0, 0],
    21: [0, 0, 0, 0, 0, 121, 0, 0, 0, 0],
    23: [0, 0, 0, 0, 0, 141, 0, 0, 0, 0],
    26: [0, 25, 0, 3, 0, 0, 3, 0, 0, 1],
    27: [0, 0, 0, 0, 0, 0, 0, 0, 0, 274],
    28: [0, 34, 3, 33, 1, 34, 10, 0, 0, 377],
    29: [0, 0, 0, 0, 1, 94, 0, 32, 0, 23],
}
# Published external scores of that table (test split, target type).
EXTERNAL_TEST_TYPE = {"ARI": 0.5414293089423912, "AMI": 0.6022757042267455, "V": 0.6041404407696861}

# Published test-split confusion counts for target type (rows true, cols predicted).
CONFUSION_TYPE_TEST = [
    [74, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [0, 78, 0, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 134, 0, 0, 0, 0, 0, 0, 0],
    [0, 1, 9, 40, 0, 0, 1, 0, 0, 0],
    [3, 0, 0, 0, 79, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, 0, 2438, 0, 0, 0, 0],
    [0, 4, 5, 0, 12, 0, 111, 0, 6, 0],
    [0, 0, 0, 0, 0, 7, 0, 71, 0, 0],
    [0, 0, 0, 0, 0, 0, 1, 0, 3158, 5],
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 4747],
]
# Published global metrics for target type on test.
GLOBAL_TYPE_TEST = {"accuracy": 0.9950837581937363, "balanced_accuracy": 0.9460436262225163,
                    "macroF1": 0.9525472872166855, "weightedF1": 0.9949542951338015,
                    "MCC": 0.9927788332201088}
# Published per-class rows for target type on test (precision, recall, f1).
CLASS_REPORT_TYPE_TEST = {
    "injection": (1.0, 0.7843137254901961, 0.8791208791208791),
    "password": (0.9823008849557522, 0.8043478260869565, 0.8844621513944223),
    "macro avg": (0.9650824647684564, 0.9460436262225163, 0.9525472872166855),
    "weighted avg": (0.9953124589779451, 0.9950837581937363, 0.9949542951338015),
}
# Published purity rows (cluster -> purity, size, dominant type).
PURITY = {14: (1.0, 1166, "normal"), 11: (0.9970394736842105, 3040, "xss"),
          0: (0.8302603036876356, 3688, "scanning"), 17: (0.5, 14, "xss"),
          10: (0.5669291338582677, 127, "backdoor")}
# Published coverage at purity thresholds.
COVERAGE = {0.5: 1.0, 0.9: 0.5259, 0.95: 0.5259, 1.0: 0.2392}
