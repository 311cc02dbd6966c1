"""Atoms, residues and trajectories as long tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.keys import stem, strip_replicate
from siftline.ordering import first_per_key, ordered_groups

# One-letter codes of standard residues.
RESIDUE_CODES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C",
    "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P",
    "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "A": "A", "C": "C", "G": "G", "U": "U",
    "DA": "A", "DC": "C", "DG": "G", "DT": "T",
}


def translate_residues(c: Column, overrides: Mapping[str, str] | None = None) -> Column:
    """One-letter code of a residue name; ``X`` if it is not known.

    ``overrides`` adds codes, say of modified residues; longer tables go through
    ``code_residues``.
    """
    pairs = {**RESIDUE_CODES, **(overrides or {})}
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit("X"))


def code_residues(residues: DataFrame, codes: DataFrame, residue: str = "residue", name: str = "code") -> DataFrame:
    """Residues with their one-letter ``name`` from a table ``(residue, code)`` of modified ones.

    The table's codes are upper-cased and win over the standard ones; of repeated
    rows the least code counts. Unknown residues are ``X``.
    """
    table = codes.groupBy(F.col("residue").alias("_residue")).agg(F.min(F.upper("code")).alias("_code"))
    joined = residues.join(table, F.col(residue) == F.col("_residue"), "left")
    return joined.select(*residues.columns, F.coalesce("_code", translate_residues(F.col(residue))).alias(name))


def first_ca(atoms: DataFrame, keys: Sequence[str] = ("file", "chain")) -> DataFrame:
    """First CA atom of every residue; a residue is its number with its insertion code.

    Residues 100, 100A and 100B are three. Ordered by the atom's serial number,
    which also gives the residues' order in a chain.
    """
    ca = atoms.filter("is_atom and atom_name = 'CA'")
    return first_per_key(ca, [*keys, "residue_index", "insertion_code"], ["serial"])


def chain_sequences(
    residues: DataFrame,
    keys: Sequence[str] = ("structure", "chain"),
    position: str = "position",
    residue: str = "residue",
    overrides: Mapping[str, str] | None = None,
    **sizes: int,
) -> DataFrame:
    """Sequence of each chain in residue order: (keys, segment, sequence).

    Segments of ``block`` residues count from 0.
    """
    code = translate_residues(F.col(residue), overrides)
    grouped = ordered_groups(residues, list(keys), [position], code, **sizes)
    return grouped.select(*keys, "segment", F.array_join("items", "").alias("sequence"))


def mapping_rows(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """Rows (keep, residue, energy) of a ``{residue: energy}`` text cell; bad text fails."""
    quoted = F.regexp_replace(F.replace(F.col(column), F.lit("'"), F.lit('"')), r"([{,]\s*)(-?\d+)\s*:", '$1"$2":')
    parsed = F.from_json(quoted, "map<string,double>", {"mode": "FAILFAST"})
    return df.select(*keep, F.explode(parsed).alias("_r", "energy")).select(
        *keep, F.col("_r").cast("int").alias("residue"), "energy"
    )


def structure_name(c: Column) -> Column:
    """Lower-case structure name of a replicate file."""
    return F.lower(strip_replicate(stem(c)))


def residue_positions(
    energies: DataFrame,
    below: float = -5.0,
    structure: str = "structure",
    chain: str = "chain",
    residue: str = "residue",
    energy: str = "energy",
    **sizes: int,
) -> DataFrame:
    """Residues whose lowest energy is under a threshold: (structure, segment, fixed_positions).

    Positions are ordered by chain and residue, ``NONE`` if there are none. A
    structure's positions stand in segments of ``block``, from 0.
    """
    lowest = energies.groupBy(structure, chain, residue).agg(F.min(energy).alias("_min"))
    label = F.concat(F.col(chain), F.col(residue).cast("string"))
    listed = ordered_groups(
        lowest, [structure], [chain, residue], label, F.col("_min") < below, **sizes
    )
    text = F.when(F.size("items") > 0, F.array_join("items", ",")).otherwise("NONE")
    return listed.select(structure, "segment", text.alias("fixed_positions"))


_XYZ = ("x", "y", "z")


def rmsd(
    atoms: DataFrame, keys: Sequence[str] = ("traj",), frame: str = "frame", atom: str = "atom", reference: int = 0
) -> DataFrame:
    """Root mean square distance of every frame from the reference frame.

    Frames are superposed already; the reference frame is one small slice.
    """
    keys = list(keys)
    first = atoms.filter(F.col(frame) == reference).select(
        *keys, atom, *[F.col(c).alias(f"_{c}") for c in _XYZ]
    )
    gap = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in _XYZ), F.lit(0.0))
    return atoms.join(first, [*keys, atom]).groupBy(*keys, frame).agg(F.sqrt(F.avg(gap)).alias("rmsd"))


def gyration(
    atoms: DataFrame, keys: Sequence[str] = ("traj",), frame: str = "frame", mass: Column | None = None
) -> DataFrame:
    """Mass-weighted radius of gyration of every frame.

    Positions are taken from the frame's plain mean, so that distances are not
    lost in large coordinates. Both steps are aggregates by frame.
    """
    keys = [*keys, frame]
    weighted = atoms.select(*keys, *_XYZ, (F.lit(1.0) if mass is None else mass).cast("double").alias("_m"))
    means = weighted.groupBy(*keys).agg(*[F.avg(c).alias(f"_{c}") for c in _XYZ])
    near = weighted.join(means, keys).select(*keys, "_m", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in _XYZ])
    total, spread = F.sum("_m"), F.lit(0.0)
    for c in _XYZ:
        centre = F.sum(F.col("_m") * F.col(c)) / total
        spread = spread + F.sum(F.col("_m") * F.col(c) * F.col(c)) / total - centre * centre
    return near.groupBy(*keys).agg(F.sqrt(F.greatest(spread, F.lit(0.0))).alias("rg"))


def rmsf(
    atoms: DataFrame, keys: Sequence[str] = ("traj",), residue: str = "residue_index", atom: str | None = "atom_name"
) -> DataFrame:
    """Fluctuation of each residue around its mean position, from CA atoms."""
    rows = atoms if atom is None else atoms.filter(F.col(atom) == "CA")
    spread = sum((F.var_pop(c) for c in _XYZ), F.lit(0.0))
    return rows.groupBy(*keys, residue).agg(F.sqrt(spread).alias("rmsf"))


def mask_mismatch(
    atoms: DataFrame, mask: DataFrame, keys: Sequence[str] = ("structure", "label"), b_factor: str = "b_factor"
) -> DataFrame:
    """Residues whose largest temperature factor contradicts the mask: (keys, problem).

    ``mask`` has the keys and is_fixed. Fixed residues carry a factor, redesigned ones 0.
    """
    highest = atoms.groupBy(*keys).agg(F.coalesce(F.max(b_factor), F.lit(0.0)).alias("_b"))
    both = highest.withColumn("_atoms", F.lit(True)).join(mask, list(keys), "full_outer")
    problem = (
        F.when(F.col("is_fixed").isNull(), "not_in_mask")
        .when(F.col("_atoms").isNull(), "no_residue")
        .when(F.col("is_fixed") & (F.col("_b") == 0), "fixed_without_factor")
        .when(~F.col("is_fixed") & (F.col("_b") != 0), "redesigned_with_factor")
    )
    return both.select(*keys, problem.alias("problem")).filter("problem is not null")


def suffix_order(name: Column, run: str) -> list[Column]:
    """Sort key: numeric suffix after ``<run>_``, then name; other names come last."""
    base = stem(name)
    prefix = f"{run}_"
    rest = F.when(base.startswith(prefix), F.substring(base, F.lit(len(prefix) + 1), F.length(base))).otherwise(base)
    digits = F.when(rest.rlike(r"\A\s*[+-]?[0-9]+\s*\z"), F.trim(rest).try_cast("bigint"))
    return [F.coalesce(digits, F.lit(1_000_000)), name]


def check_atoms(atoms: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Files with malformed atom records or none: (by, problem, n).

    ``atoms`` comes from ``read_atoms`` and holds every line of the files.
    """
    xyz = [F.col(c) for c in _XYZ]
    finite = F.lit(True)
    for c in xyz:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    good = (
        (F.col("length") >= 54)
        & (F.col("serial") > 0)
        & (F.col("atom_name") != "")
        & finite
    )
    counts = atoms.groupBy(*by).agg(
        F.count_if(F.col("is_atom") & ~F.coalesce(good, F.lit(False))).alias("malformed"),
        F.count_if(F.col("is_atom")).alias("atoms"),
    )
    problems = F.array_compact(
        F.array(
            F.when(F.col("malformed") > 0, F.struct(F.lit("malformed").alias("problem"), F.col("malformed").alias("n"))),
            F.when(F.col("atoms") == 0, F.struct(F.lit("no_atoms").alias("problem"), F.lit(0).cast("bigint").alias("n"))),
        )
    )
    return counts.select(*by, F.explode(problems).alias("_p")).select(*by, "_p.*")
