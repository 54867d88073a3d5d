"""Names and settings of the flow data set."""

# Label column, majority class and the two binary class names.
LABEL = "Label"
MAJORITY = "Benign"
BINARY_COLUMN = "Clase"
BINARY_MAJORITY = "Benigno"
BINARY_REST = "Ataque"

# Raw columns that cleaning removes.
RAW_DROP = [
    "Bwd PSH Flags", "Bwd URG Flags", "Fwd Pkts/b Avg", "Bwd Pkts/b Avg",
    "Fwd Byts/b Avg", "Bwd Byts/b Avg", "Fwd Blk Rate Avg", "Bwd Blk Rate Avg",
    "Fwd URG Flags", "CWE Flag Count", "FIN Flag Cnt", "Timestamp",
    "Flow ID", "Src IP", "Dst IP", "Src Port", "Protocol",
]

# Raw columns that only some files have.
RAW_OPTIONAL = ["Flow ID", "Src IP", "Dst IP", "Src Port"]

# The 66 features of the cleaned data set.
FEATURES = [
    "Dst Port", "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts",
    "Fwd Pkt Len Max", "Fwd Pkt Len Min", "Fwd Pkt Len Mean", "Fwd Pkt Len Std",
    "Bwd Pkt Len Max", "Bwd Pkt Len Min", "Bwd Pkt Len Mean", "Bwd Pkt Len Std",
    "Flow Byts/s", "Flow Pkts/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Tot", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Tot", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Fwd Header Len", "Bwd Header Len", "Fwd Pkts/s", "Bwd Pkts/s",
    "Pkt Len Min", "Pkt Len Max", "Pkt Len Mean", "Pkt Len Std", "Pkt Len Var",
    "SYN Flag Cnt", "RST Flag Cnt", "PSH Flag Cnt", "ACK Flag Cnt", "URG Flag Cnt", "ECE Flag Cnt",
    "Down/Up Ratio", "Pkt Size Avg", "Fwd Seg Size Avg", "Bwd Seg Size Avg",
    "Subflow Fwd Pkts", "Subflow Fwd Byts", "Subflow Bwd Pkts", "Subflow Bwd Byts",
    "Init Fwd Win Byts", "Init Bwd Win Byts", "Fwd Act Data Pkts", "Fwd Seg Size Min",
    "Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]

# Columns known to be exact copies of an earlier column.
KNOWN_COPIES = ["SYN Flag Cnt", "Subflow Fwd Pkts", "Subflow Fwd Byts", "Subflow Bwd Pkts"]

# Columns the light forest leaves out as redundant.
REDUNDANT = [
    "SYN Flag Cnt", "Subflow Fwd Pkts", "Subflow Bwd Pkts", "Bwd Seg Size Avg",
    "Subflow Fwd Byts", "Fwd Seg Size Avg", "Subflow Bwd Byts", "ECE Flag Cnt",
    "Bwd Header Len", "TotLen Bwd Pkts", "Fwd IAT Tot", "Idle Min", "Idle Max",
    "Pkt Size Avg", "Fwd IAT Max", "Flow IAT Min", "Fwd IAT Mean",
    "Fwd Header Len", "Fwd IAT Min", "Pkt Len Max", "Bwd Pkt Len Std",
    "Pkt Len Std", "Pkt Len Min", "Fwd Pkt Len Std", "Pkt Len Mean",
]

# Columns that are never features.
NOT_FEATURES = [
    "Label", "Label_Index", "Label_Binary", "Flow ID", "Timestamp", "Src IP", "Dst IP", "Src Port", "Protocol",
]

# The rate column with invalid values, and the columns of the box and density tables.
RATE_COLUMN = "Flow Byts/s"
BOX_COLUMNS = ["Flow Duration", "Tot Fwd Pkts", "Fwd Pkt Len Mean", "ACK Flag Cnt"]
DENSITY_COLUMNS = ["Fwd Seg Size Min", "Init Bwd Win Byts", "Flow IAT Min"]

# Balancing, splitting and model settings.
BALANCE_TARGET = 700_000
FOREST_SPLIT, FOREST_SEED = (0.7, 0.3), 42
PERCEPTRON_SPLIT, PERCEPTRON_SEED = (0.8, 0.2), 1234
FOREST_LARGE = {"trees": 100, "depth": 10}
FOREST_LIGHT = {"trees": 20, "depth": 8}
PERCEPTRON = {"hidden": (64, 32), "block": 128, "iterations": 100}
HIGH_CORRELATION = 0.95
