"""Names, tags, sets and thresholds the published results depend on."""

from sitefold.operators.peptides import Event

# Strains and their display order.
CONTROL = "Ctrl"
SAMPLE_ORDER = ["Ctrl", "ProAla", "ProSer", "ArgSer"]
STRAIN_ORDER = ["ProAla", "ProSer", "ArgSer"]

# Substitutions (tag, residue, label, codons of the residue).
PRO_SER = Event("ProSer", "P[-10.0207]", "P", "P to S", ("CCA", "CCT", "CCC", "CCG"))
PRO_ALA = Event("ProAla", "P[-26.0156]", "P", "P to A", ("CCA", "CCT", "CCC", "CCG"))
ARG_SER = Event(
    "ArgSer", "R[-69.0691]", "R", "R to S", ("CGT", "CGG", "CGC", "CGA", "AGA", "AGG")
)
SUBSTITUTIONS = [PRO_SER, PRO_ALA, ARG_SER]

# New phosphosites on substituted residues.
PRO_PHOSPHO = Event("ProPhosphoSer", "P[69.9456]", "P")
ARG_PHOSPHO = Event("ArgPhosphoSer", "R[10.8972]", "R")
NEW_SITES = [PRO_PHOSPHO, ARG_PHOSPHO]
ARG_PHOSPHO_MOTIF = "R[10.8972]P"

# Other modification tags and the text that stays.
PLAIN_TAGS = {
    "M[15.9949]": "M",
    "n[42.0106]": "",
    "C[57.0215]": "C",
    "S[79.9663]": "S",
    "T[79.9663]": "T",
    "Y[79.9663]": "Y",
}
SITE_TAG = "UniMod:21"
MIN_SUPPORT = 6
FLANK = 7
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

# Growth table replicates and the strain left out.
REPLICATE_LETTERS = {"A": "1", "B": "2", "C": "3", "D": "4", "E": "5", "F": "6"}
GROWTH_EXCLUDED = ["Y69"]

# Contrasts against the control.
CONTRASTS = {
    "ProAla_vs_Ctrl": {"ProAla": 1.0, "Ctrl": -1.0},
    "ProSer_vs_Ctrl": {"ProSer": 1.0, "Ctrl": -1.0},
    "ArgSer_vs_Ctrl": {"ArgSer": 1.0, "Ctrl": -1.0},
}
MATRIX_LABELS = ["ProSer_vs_Ctrl", "ArgSer_vs_Ctrl", "ProAla_vs_Ctrl"]
LABEL_SHORT = {"ProAla_vs_Ctrl": "P→A", "ProSer_vs_Ctrl": "P→S", "ArgSer_vs_Ctrl": "R→S"}
LABEL_LONG = {
    "ProAla_vs_Ctrl": "Pro→Ala", "ProSer_vs_Ctrl": "Pro→Ser", "ArgSer_vs_Ctrl": "Arg→Ser",
}
GROUP_SHORT = {"ProAla": "P→A", "ProSer": "P→S", "ArgSer": "R→S", "Ctrl": "EV"}

# Hit rule and cluster counts.
ALPHA = 0.05
LOG2_FOLD = 0.6
PROTEIN_CLUSTERS = 4
SITE_CLUSTERS = 3

# Axis limits that drop values before box statistics.
PROTEIN_CV_LIMITS = (0.0, 100.0)
SITE_CV_LIMITS = (0.0, 200.0)
PROFILE_LIMITS = {"CLB2": (17.0, 20.0), "SIC1": (18.5, 20.5)}

# Kinases and gene shown on their own.
SHOWN_KINASES = ["ATG1", "CDC28", "TORC1"]
SITE_GENE = "EFT1"

# Protein panels, name -> (members, display order, star alpha).
PROTEIN_PANELS = {
    "Hsp70": (
        ["SSA1", "SSA2", "SSA3", "SSA4", "SSB1", "SSB2", "SSE1", "SSE2", "SSZ1", "KAR2", "LHS1",
         "SSC1", "SSQ1", "ECM10"],
        ["SSA1", "SSA2", "SSA3", "SSA4", "SSB1", "SSB2", "SSE1", "SSE2", "SSZ1", "KAR2", "LHS1",
         "SSC1", "SSQ1"],
        0.01,
    ),
    "Hsp40": (
        ["YDJ1", "XDJ1", "APJ1", "SIS1", "DJP1", "ZUO1", "SWA2", "JJJ1", "JJJ2", "JJJ3", "CAJ1",
         "CWC23", "MDJ1", "MDJ2", "PAM18", "JAC1", "JID1", "SCJ1", "HLJ1", "JEM1", "SEC63", "ERJ5"],
        ["YDJ1", "XDJ1", "APJ1", "SIS1", "DJP1", "ZUO1", "SWA2", "JJJ1", "CAJ1", "CWC23", "MDJ1",
         "PAM18", "JAC1", "SCJ1", "HLJ1", "JEM1", "SEC63", "ERJ5"],
        0.01,
    ),
    "Hsp90": (
        ["HSP82", "HSC82", "STI1", "CDC37", "CNS1", "SBA1", "CPR6", "CPR7", "HCH1", "AHA1"],
        ["HSP82", "HSC82", "STI1", "CDC37", "CNS1", "SBA1", "CPR6", "CPR7", "HCH1", "AHA1"],
        0.01,
    ),
    "Other chaperones": (["HSP104", "HSP42", "HSP26"], ["HSP104", "HSP42", "HSP26"], 0.01),
    "Proteasome": (
        ["PRE1", "PRE2", "PRE3", "PRE4", "PRE5", "PRE6", "PRE7", "PRE8", "PRE9", "PRE10", "PUP1",
         "PUP2", "PUP3", "RPN1", "RPN2", "RPN3", "RPN5", "RPN6", "RPN7", "RPN8", "RPN9", "RPN10",
         "RPN11", "RPN12", "RPN13", "RPT1", "RPT2", "RPT3", "RPT4", "RPT5", "RPT6", "SCL1", "SEM1"],
        [],
        0.01,
    ),
    "Autophagy": (
        ["ATG1", "ATG13", "ATG17", "ATG29", "ATG31", "ATG9", "VPS15", "VPS30", "VPS34", "ATG14",
         "ATG38", "ATG2", "ATG18", "ATG21", "ATG5", "ATG10", "ATG12", "ATG16", "ATG7", "ATG3",
         "ATG4", "ATG8"],
        ["ATG1", "ATG13", "ATG17", "ATG29", "ATG31", "ATG9", "VPS15", "VPS30", "VPS34", "ATG38",
         "ATG2", "ATG18", "ATG21", "ATG5", "ATG12", "ATG16", "ATG7", "ATG3", "ATG4", "ATG8"],
        0.01,
    ),
    "Cdc5": (["CDC5"], ["CDC5"], 0.05),
}

# Site panels, name -> (members, display order, star alpha).
SITE_PANELS = {
    "Cdc5 site": (["CDC5_T70"], ["CDC5_T70"], 0.01),
    "Cdc14": (["CDC14_S408", "CDC14_S429"], ["CDC14_S408", "CDC14_S429"], 0.05),
    "Net1": (
        ["NET1_T676", "NET1_T357", "NET1_T288", "NET1_T1017", "NET1_S830", "NET1_S803",
         "NET1_S744", "NET1_S679", "NET1_S385", "NET1_S166", "NET1_S1032"],
        ["NET1_S166", "NET1_T288", "NET1_T357", "NET1_S385", "NET1_T676", "NET1_S679",
         "NET1_S744", "NET1_S803", "NET1_S830", "NET1_T1017", "NET1_S1032"],
        0.05,
    ),
    "Bfa1": (["BFA1_S274", "BFA1_T340"], ["BFA1_S274", "BFA1_T340"], 0.05),
    "Nud1": (
        ["NUD1_S63", "NUD1_S240", "NUD1_S460"], ["NUD1_S63", "NUD1_S240", "NUD1_S460"], 0.05,
    ),
    "Ded1": (
        ["DED1_T282", "DED1_S576", "DED1_S572", "DED1_S55", "DED1_S543", "DED1_S369", "DED1_S263"],
        ["DED1_S55", "DED1_S263", "DED1_T282", "DED1_S369", "DED1_S543", "DED1_S572", "DED1_S576"],
        0.05,
    ),
    "Sup45": (["SUP45_S67"], ["SUP45_S67"], 0.05),
    "Tef1": (["TEF1_S237", "TEF1_T240"], ["TEF1_S237", "TEF1_T240"], 0.05),
    "Sui2": (["SUI2_S52", "SUI2_S91"], ["SUI2_S52", "SUI2_S91"], 0.05),
    "Tif4631": (
        ["TIF4631_T276", "TIF4631_S916", "TIF4631_S920", "TIF4631_S502"],
        ["TIF4631_T276", "TIF4631_S502", "TIF4631_S916", "TIF4631_S920"],
        0.05,
    ),
}
