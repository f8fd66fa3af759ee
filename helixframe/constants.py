"""The biological tables, thresholds and labels the rules need.

Everything in this module is a plain value, stated as text in its natural
order.  No logic lives here; :mod:`helixframe.dims` turns the tables into
DataFrames and into SQL ``VALUES`` lists.
"""

from __future__ import annotations

# --- fixed values: genes -----------------------------------------------------
GENE_COLUMNS = (
    "gene", "gid", "chromosome", "strand", "genomic_start", "genomic_end", "cds_length",
    "aa_length", "transcript", "ba1", "bs1", "xgb_weight", "mlp_weight", "threshold",
)
GENES = [
    ("BRCA1", 0, "17", "-", 43044292, 43170245, 5592, 1863, "NM_007294.4", 0.001, 0.0001, 0.6, 0.4, 0.5),
    ("BRCA2", 1, "13", "+", 32315086, 32400268, 10257, 3418, "NM_000059.4", 0.001, 0.0001, 0.6, 0.4, 0.5),
    ("PALB2", 2, "16", "-", 23603160, 23641321, 3561, 1186, "NM_024675.4", 0.002, 0.0005, 0.6, 0.4, 0.5),
    ("RAD51C", 3, "17", "+", 58692573, 58735611, 1131, 376, "NM_058216.3", 0.005, 0.001, 0.6, 0.4, 0.5),
    ("RAD51D", 4, "17", "-", 35092221, 35121522, 987, 328, "NM_002878.4", 0.005, 0.001, 0.6, 0.4, 0.5),
]
DEFAULT_BA1 = 0.01
DEFAULT_BS1 = 0.001

# --- fixed values: protein domains, in configured order ----------------------
DOMAIN_COLUMNS = ("gene", "name", "start_aa", "end_aa", "ord")
DOMAINS = [
    ("BRCA1", "RING", 8, 96, 0),
    ("BRCA1", "BARD1_interaction", 8, 96, 1),
    ("BRCA1", "DNA_binding", 452, 1079, 2),
    ("BRCA1", "PALB2_interaction", 1364, 1437, 3),
    ("BRCA1", "SCD", 1280, 1524, 4),
    ("BRCA1", "BRCT1", 1646, 1736, 5),
    ("BRCA1", "BRCT2", 1760, 1855, 6),
    ("BRCA2", "PALB2_interaction", 10, 40, 0),
    ("BRCA2", "BRC_repeats", 1009, 2083, 1),
    ("BRCA2", "DNA_binding", 2402, 3190, 2),
    ("BRCA2", "OB_folds", 2670, 3102, 3),
    ("BRCA2", "NLS_nuclear_localization", 3263, 3330, 4),
    ("PALB2", "BRCA1_interaction", 9, 42, 0),
    ("PALB2", "ChAM_DNA_binding", 395, 442, 1),
    ("PALB2", "BRCA2_interaction", 1085, 1186, 2),
    ("PALB2", "WD40_repeats", 853, 1186, 3),
    ("RAD51C", "Holliday_junction_resolution", 1, 126, 0),
    ("RAD51C", "RAD51B_RAD51D_XRCC3_interaction", 79, 136, 1),
    ("RAD51C", "Walker_A", 135, 142, 2),
    ("RAD51C", "Walker_B", 238, 242, 3),
    ("RAD51C", "NLS_nuclear_localization", 366, 370, 4),
    ("RAD51D", "ssDNA_binding", 1, 83, 0),
    ("RAD51D", "N_terminal_domain", 2, 28, 1),
    ("RAD51D", "Walker_A", 108, 115, 2),
    ("RAD51D", "Walker_B", 206, 210, 3),
]

# --- fixed values: generic domain flags and their candidate names, by rank ---
DOMAIN_FLAGS = {
    "in_critical_repeat_region": ["BRC_repeats", "WD40_repeats", "BRCT1", "BRCT2", "SCD"],
    "in_DNA_binding": ["DNA_binding", "ChAM_DNA_binding", "ssDNA_binding"],
    "in_OB_folds": ["OB_folds", "RING", "Walker_A", "Walker_B"],
    "in_NLS": ["NLS_nuclear_localization", "N_terminal_domain"],
    "in_primary_interaction": [
        "PALB2_interaction", "BRCA1_interaction", "BARD1_interaction",
        "RAD51B_RAD51D_XRCC3_interaction", "Holliday_junction_resolution",
    ],
}

# --- fixed values: residues (three-letter, one-letter, volume, hydropathy, charge class)
RESIDUE_COLUMNS = ("aa", "one", "volume", "hydro", "charge")
RESIDUES = [
    ("Ala", "A", 67.0, 1.8, "nonpolar"),
    ("Arg", "R", 148.0, -4.5, "positive"),
    ("Asn", "N", 96.0, -3.5, "polar"),
    ("Asp", "D", 91.0, -3.5, "negative"),
    ("Cys", "C", 86.0, 2.5, "polar"),
    ("Gln", "Q", 114.0, -3.5, "polar"),
    ("Glu", "E", 109.0, -3.5, "negative"),
    ("Gly", "G", 48.0, -0.4, "nonpolar"),
    ("His", "H", 118.0, -3.2, "positive"),
    ("Ile", "I", 124.0, 4.5, "nonpolar"),
    ("Leu", "L", 124.0, 3.8, "nonpolar"),
    ("Lys", "K", 135.0, -3.9, "positive"),
    ("Met", "M", 124.0, 1.9, "nonpolar"),
    ("Phe", "F", 135.0, 2.8, "nonpolar"),
    ("Pro", "P", 90.0, -1.6, "nonpolar"),
    ("Ser", "S", 73.0, -0.8, "polar"),
    ("Thr", "T", 93.0, -0.7, "polar"),
    ("Trp", "W", 163.0, -0.9, "nonpolar"),
    ("Tyr", "Y", 141.0, -1.3, "polar"),
    ("Val", "V", 105.0, 4.2, "nonpolar"),
    ("Ter", "*", 0.0, -10.0, "other"),
]
STANDARD_RESIDUES = [r[0] for r in RESIDUES if r[0] != "Ter"]
ONEHOT_RESIDUES = sorted(r[0] for r in RESIDUES)

# --- fixed values: substitution scores, lower triangle without the diagonal --
# Columns follow the row order; equal residues score 4, a stop scores -4 and
# anything unknown -1.
SUBSTITUTION_TRIANGLE = """
Ala
Arg -1
Asn -2 -1
Asp -2 -2  1
Cys  0 -3 -3 -3
Gln -1  1  0  0 -3
Glu -1  0  0  2 -4  2
Gly  0 -2  0 -1 -3 -2 -2
His -2  0  1 -1 -3  0  0 -2
Ile -1 -3 -3 -3 -1 -3 -3 -4 -3
Leu -1 -2 -3 -4 -1 -2 -3 -4 -3  2
Lys -1  2  0 -1 -3  1  1 -2 -1 -1 -2
Met -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1
Phe -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0
Pro -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4
Ser  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1
Thr  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1
Trp -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2
Tyr -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2
Val  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1
"""
SCORE_SAME, SCORE_STOP, SCORE_UNKNOWN = 4, -4, -1

# --- fixed values: standard genetic code, bases in TCAG order ----------------
GENETIC_CODE = {
    "TTT": "Phe", "TTC": "Phe", "TTA": "Leu", "TTG": "Leu",
    "TCT": "Ser", "TCC": "Ser", "TCA": "Ser", "TCG": "Ser",
    "TAT": "Tyr", "TAC": "Tyr", "TAA": "Ter", "TAG": "Ter",
    "TGT": "Cys", "TGC": "Cys", "TGA": "Ter", "TGG": "Trp",
    "CTT": "Leu", "CTC": "Leu", "CTA": "Leu", "CTG": "Leu",
    "CCT": "Pro", "CCC": "Pro", "CCA": "Pro", "CCG": "Pro",
    "CAT": "His", "CAC": "His", "CAA": "Gln", "CAG": "Gln",
    "CGT": "Arg", "CGC": "Arg", "CGA": "Arg", "CGG": "Arg",
    "ATT": "Ile", "ATC": "Ile", "ATA": "Ile", "ATG": "Met",
    "ACT": "Thr", "ACC": "Thr", "ACA": "Thr", "ACG": "Thr",
    "AAT": "Asn", "AAC": "Asn", "AAA": "Lys", "AAG": "Lys",
    "AGT": "Ser", "AGC": "Ser", "AGA": "Arg", "AGG": "Arg",
    "GTT": "Val", "GTC": "Val", "GTA": "Val", "GTG": "Val",
    "GCT": "Ala", "GCC": "Ala", "GCA": "Ala", "GCG": "Ala",
    "GAT": "Asp", "GAC": "Asp", "GAA": "Glu", "GAG": "Glu",
    "GGT": "Gly", "GGC": "Gly", "GGA": "Gly", "GGG": "Gly",
}

# --- fixed values: nucleotide changes ----------------------------------------
MUTATIONS = ["A>C", "A>G", "A>T", "C>A", "C>G", "C>T", "G>A", "G>C", "G>T", "T>A", "T>C", "T>G"]
TRANSITIONS = ["A>G", "G>A", "C>T", "T>C"]
VARIANT_TYPE_TOKENS = ["FS", "DEL", "INS", "DUP"]
TRUNCATING_ALT = ["Ter", "*", "Fs"]

# --- fixed values: population codes ------------------------------------------
POPULATION_AF = {
    "afr": "af_afr", "amr": "af_amr", "asj": "af_asj", "eas": "af_eas",
    "fin": "af_fin", "nfe": "af_nfe", "sas": "af_sas",
}
UNDERREPRESENTED = ["kazakh", "central_asian", "kz"]
SPARSE_MULTIPLIER = 2.0
ANCESTRY_ORDER = ["AFR", "AMR", "EAS", "NFE"]

# --- fixed values: evidence thresholds and code strengths --------------------
PP3_MIN, BP4_MAX = 0.70, 0.20
PM1_DISTANCE = 5.0
DISTANCE_UNKNOWN = 999.0
EVIDENCE_STRENGTH = {
    "pvs": ["PVS1"],
    "ps": ["PS1", "PS2", "PS3", "PS4"],
    "pm": ["PM1", "PM2", "PM3", "PM4", "PM5", "PM6", "PVS1_moderate"],
    "pp": ["PP1", "PP2", "PP3", "PP3_splice", "PP4", "PP5"],
    "ba": ["BA1"],
    "bs": ["BS1", "BS2", "BS3", "BS4"],
    "bp": ["BP1", "BP2", "BP3", "BP4", "BP5", "BP6", "BP7"],
}
CLASSES = ["Pathogenic", "Likely Pathogenic", "Uncertain Significance", "Likely Benign", "Benign"]

# --- fixed values: structure and sequence defaults ---------------------------
DEFAULT_RSA, DEFAULT_BFACTOR = 0.4, 50.0
BURIED_RSA = 0.25
HELIX_CODES, SHEET_CODES = ["H", "G", "I"], ["E", "B"]
NEIGHBOUR_RADIUS = 10.0
CONTEXT_WINDOW = 50
NEARBY_WINDOW = 50

# --- fixed values: score cut-offs --------------------------------------------
SCORE_BANDS = {"assay": (1.49, 2.50), "substitution_model": (0.340, 0.564), "dms": (-1.328, -0.748)}
RISK_BOUNDS = {"pathogenic": 0.9, "likely_pathogenic": 0.7, "benign": 0.1, "likely_benign": 0.3}
RECLASS = {"LP": 0.80, "PP": 0.60, "LB": 0.10, "PB": 0.20}
CLIP_BATCH, CLIP_SINGLE = (0.005, 0.995), (0.01, 0.99)
CONFORMAL_ALPHA, CONFORMAL_MIN = 0.10, 20
CI_WIDEN = 1.5
FREQUENCY_FEATURES = [
    "gnomad_af", "gnomad_popmax_af", "gnomad_af_afr", "gnomad_af_amr", "gnomad_af_eas",
    "gnomad_af_nfe", "gnomad_af_log", "gnomad_popmax_log", "is_rare", "is_popmax_rare", "af_x_blosum",
]
LEAK_FEATURES = ["cDNA_pos", "AA_pos", "is_transition", "is_transversion"]
CONFIG_REQUIRED = ["aa_length", "cds_length", "chromosome", "domains", "strand"]
