"""Declared schemas of the input tables (snake_case after the scan).

Only the columns the analysis touches are listed; parquet scans prune the rest.
"""

from __future__ import annotations

import re

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType

S, D, I, L = StringType(), DoubleType(), IntegerType(), LongType()

PRECURSOR_COLUMNS = {
    "Run": "run", "Decoy": "decoy", "Q.Value": "q_value", "Global.Q.Value": "global_q_value",
    "Quantity.Quality": "quantity_quality", "Genes": "genes",
    "Modified.Sequence": "modified_sequence", "Precursor.Charge": "precursor_charge",
    "Precursor.Quantity": "precursor_quantity",
}
PHOSPHO_COLUMNS = {
    **PRECURSOR_COLUMNS, "PTM.Site.Confidence": "ptm_site_confidence",
    "Global.Peptidoform.Q.Value": "global_peptidoform_q_value", "Protein.Sites": "protein_sites",
}
PEPTIDE_ID_TYPES = {
    "Peptide.Sequence": S, "Modified.Sequence": S, "Start": I, "End": I, "Gene": S,
    "Mapped.Genes": S, "Protein.ID": S,
}
ABUNDANCE = {
    "originalRUN": S, "GROUP": S, "SUBJECT": S, "Protein": S, "LogIntensities": D,
}
DIFFERENTIAL = {"Protein": S, "Label": S, "log2FC": D, "adj.pvalue": D, "GlobalProtein": S}
GROWTH = {"Replicate": S, "tRNA": S, "Normalized": D}
PROTEIN_SEQUENCES = {"GeneName": S, "Sequence": S, "Reference": S}
UNIPROT = {"Gene": S, "Reference": S}
KINASE_SUBSTRATE = {"ref": S, "kinase_activity": S}
PROTEIN_LENGTHS = {"Entry": S, "Gene Names": S, "Length": I}


def snake(name: str) -> str:
    """``Global.Q.Value`` -> ``global_q_value``; ``LogIntensities`` -> ``log_intensities``."""
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip())
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower()
