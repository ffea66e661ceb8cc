"""Residue alphabets, decoding grids and default job parameters."""

# Alphabets (fixed values).
ENTROPY_ALPHABET = "ACDEFGHIKLMNPQRSTVWYX"
MUTABLE_ALPHABET = "ARNDCQEGHILKMFPSTWYV"
COLUMN_ALPHABET = "ACDEFGHIKLMNPQRSTVWY-X"
THREE_DI_ALPHABET = "acdefghiklmnpqrstvwy"
RESIDUES_ONLY = 20  # leading letters of COLUMN_ALPHABET that are residues

# Default job parameters (fixed values).
DEFAULT_COVERAGE = [1.0]
DEFAULT_MUTATION_RATES = {"MEGABLAST": 5.0, "PAM250": 20.0, "BLOSUM62": 10.0}
FALLBACK_MUTATION_RATE = 5.0
DEFAULT_DECODING = {
    "base": {"top_k": 20.0, "top_p": 0.95},
    "matrix": {"temperature": [0.2, 0.7, 1.2], "repetition_penalty": [1.0, 1.5]},
}
DEFAULT_RETURNS = 5
DEFAULT_MULTIPLIER = 5

# Depth ladder: (max sequences, max extra sequences) per level (fixed values).
DEPTH_LADDER = [(16, 32), (32, 64), (64, 128), (128, 256)]
DEFAULT_DEPTH = [(64, 64)]
