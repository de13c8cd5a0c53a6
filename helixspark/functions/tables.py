"""Lookup tables: taxonomy, aliases, 10-mer scores, score ranges, nearest-neighbour energies."""

from __future__ import annotations

import itertools

# Classes and their subclasses, in the order of their numbers.
TAXONOMY = {
    "Curved_DNA": ["Global Curvature", "Local Curvature"],
    "Slipped_DNA": ["Direct Repeat", "STR"],
    "Cruciform": ["Cruciform forming IRs"],
    "R-Loop": ["R-loop formation sites"],
    "Triplex": ["H-DNA", "Sticky DNA"],
    "G-Quadruplex": ["Telomeric G4", "Stacked G4", "Canonical intramolecular G4", "Extended-loop canonical", "Higher-order G4 array/G4-wire", "Intramolecular G-triplex", "Two-tetrad weak PQS", "Bulged G4"],
    "i-Motif": ["Canonical i-motif", "Relaxed i-motif", "AC-motif"],
    "Z-DNA": ["Z-DNA", "eGZ"],
    "A-philic_DNA": ["A-philic DNA"],
    "Hybrid": ["Dynamic overlaps"],
    "Non-B_DNA_Clusters": ["Dynamic clusters"],
}
DERIVED = ("Hybrid", "Non-B_DNA_Clusters")

# Other spellings of classes (lower-cased), beside the names themselves.
CLASS_ALIASES = {
    "curved dna": "Curved_DNA", "curveddna": "Curved_DNA", "curved-dna": "Curved_DNA",
    "slipped dna": "Slipped_DNA", "slippeddna": "Slipped_DNA", "slipped-dna": "Slipped_DNA",
    "cruciform dna": "Cruciform",
    "rloop": "R-Loop", "r loop": "R-Loop",
    "triplex dna": "Triplex",
    "gquadruplex": "G-Quadruplex", "g quadruplex": "G-Quadruplex", "g4": "G-Quadruplex",
    "imotif": "i-Motif", "i motif": "i-Motif",
    "zdna": "Z-DNA", "z dna": "Z-DNA",
    "a-philic dna": "A-philic_DNA", "aphilic dna": "A-philic_DNA", "aphilic_dna": "A-philic_DNA",
    "non-b dna clusters": "Non-B_DNA_Clusters", "clusters": "Non-B_DNA_Clusters",
} | {name.lower(): name for name in TAXONOMY}
# Other spellings of subclasses (lower-cased), beside the names themselves.
SUBCLASS_ALIASES = {
    "inverted repeats": "Cruciform forming IRs", "inverted repeat": "Cruciform forming IRs",
    "qmrlfs-m1": "R-loop formation sites", "qmrlfs-m2": "R-loop formation sites",
    "triplex": "H-DNA", "triplex_motif": "H-DNA", "triplex motif": "H-DNA", "h_dna": "H-DNA", "hdna": "H-DNA",
    "sticky_dna": "Sticky DNA",
    "stacked canonical g4s": "Stacked G4", "stacked g4s with linker": "Stacked G4",
    "canonical_imotif": "Canonical i-motif", "relaxed_imotif": "Relaxed i-motif", "ac motif": "AC-motif",
    "egz-motif": "eGZ",
} | {name.lower(): name for names in TAXONOMY.values() for name in names}

CLASS_OF = {sub: name for name, subs in TAXONOMY.items() for sub in subs}

# Weights of the steps between alternating bases; other steps weigh nothing.
Z_STEPS = {"CG": 7.0, "GC": 7.0, "AC": 1.25, "CA": 1.25, "GT": 1.25, "TG": 1.25, "AT": 1.0, "TA": 1.0}
Z_LEAST = 50.0
# log2 propensities of the tetramers that A-philic 10-mers consist of.
A_TETRAMERS = {
    "ACCC": 0.848, "AGGG": 3.7004, "CCCA": 2.0704, "CCCC": 2.5361, "CCCG": 0.848, "CCCT": 3.7004, "CCGG": 0.2591, "CCTA": 1.585,
    "CGGG": 0.848, "GCCC": 2.4021, "GGCC": 0.1343, "GGGC": 2.4021, "GGGG": 2.5361, "GGGT": 0.848, "TAGG": 1.585, "TGGG": 2.0704,
}
# Nearest-neighbour stacking energies, kcal/mol.
STACKING = {
    "AA": -1.0, "AC": -1.44, "AG": -1.28, "AT": -0.88, "CA": -1.45, "CC": -1.84, "CG": -2.17, "CT": -1.28,
    "GA": -1.30, "GC": -2.24, "GG": -1.84, "GT": -1.44, "TA": -0.58, "TC": -1.30, "TG": -1.45, "TT": -1.0,
}


def z_tenmers() -> list[tuple[str, float]]:
    """10-mers whose steps weigh at least Z_LEAST together. The rule was inferred from the 126 entries that the table must have, and gives them."""
    found, grow = [], [(b, 0.0) for b in "ACGT"]
    while grow:
        s, total = grow.pop()
        if len(s) == 10:
            found.append((s, total))
            continue
        for b in "ACGT":
            t = total + Z_STEPS.get(s[-1] + b, 0.0)
            if t + 7.0 * (9 - len(s)) >= Z_LEAST:
                grow.append((s + b, t))
    return sorted(found)


def a_tenmers() -> list[tuple[str, float]]:
    """10-mers that consist of the A-philic tetramers, with the mean of their seven propensities. The rule was inferred from the 208 entries that the table must have, and gives them."""
    grow = list(A_TETRAMERS)
    for _ in range(6):
        grow = [s + b for s, b in itertools.product(grow, "ACGT") if s[-3:] + b in A_TETRAMERS]
    return sorted((s, round(sum(A_TETRAMERS[s[i : i + 4]] for i in range(7)), 4) / 7) for s in grow)
