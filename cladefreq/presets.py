"""Thresholds, headers, names and lists that decide the results.

Every operator takes these as parameters; the values below are the defaults of
the defence-system study the operators were designed around.
"""

from __future__ import annotations

# Entity table.
SENTINEL = "#N/A"
EXCLUDED_DOMAIN = "d__Archaea"
GROUP_RANK, GROUP_PREFIX = 2, "p__"
SUBGROUP_RANK, SUBGROUP_PREFIX = 5, "f__"
STRIPPED_SUFFIXES = ("A", "B", "F")
ENTITY_EXPORT_COLUMNS = (
    "accession_genbank",
    "database",
    "isol_env",
    "host_species",
    "dependent",
    "oxygen_requirement",
    "classification",
)

# Evidence table.
MAX_E_VALUE = 0.01
MIN_COVERAGE = 0.8

# Array table: header names in file order.
MIN_PROBABILITY = 0.75
ARRAY_COLUMNS = (
    "AccessionID",
    "Contig",
    "CRISPR",
    "Start",
    "End",
    "Consensus_repeat",
    "N_repeats",
    "Repeat_len",
    "Spacer_len_avg",
    "Repeat_identity",
    "Spacer_identity",
    "Spacer_len_sem",
    "Trusted",
    "Prediction",
    "Subtype",
    "Subtype_probability",
)

# Pattern subsets of the evidence table.
ARGONAUTE_PATTERN, ARGONAUTE_NAME = "pAgo_(I|II)", "pAgo"
RETRON_TYPE_PATTERN, RETRON_PROTEIN_PATTERN = "^retron", "^RT"

# Feature names.
EXCLUDED_FEATURES = ("CRISPR-Cas_padloc", "DMS")
FEATURE_RECODE = {"CRISPR-Cas_cctyper": "CRISPR-Cas"}
SHARE_FEATURE = "CRISPR-Cas"
VENN_SETS = {
    "RM": ("RM",),
    "dXTPase": ("dXTPase",),
    "CRISPR-Cas": ("CRISPR-Cas",),
    "other_system": (
        "Phosphorothioation", "Argonaute", "Septu", "Thoeris", "Zorya", "Dpd",
        "PARIS", "Mza", "Hachiman", "Viperin", "BREX", "ietAS", "Wadjet", "GAO",
        "Hhe", "Retron", "DarTG", "Helicase-DUF2290", "Shedu", "AVAST", "Pycsar",
        "Lamassu", "Upx", "RADAR", "Druantia", "Kiwa", "qatABCD", "Gasdermin",
        "Ppl", "Tmn", "Dsr", "TIR-NLR", "Hma", "Paris_fused", "TerY-P", "Nhi",
        "DISARM", "DUF4238", "DprA-PRTase", "3HP", "Hydrolase-TM", "Abi", "DRT",
        "CBASS", "Gabija",
    ),
}

# Cuts (all strict, except the cos2 cut).
MIN_GROUP_SIZE = 5
MIN_FEATURE_TOTAL = 5
MIN_COS2 = 0.02
ROTATE_ABOVE = 100
