"""Molecular identity behind a backend, which an optional package supplies.

A backend has ``describe(smiles) -> (identity, bits) | None`` (None: not one valid
molecule; bits: 2048 as a list of 32 signed longs) and ``scaffold(smiles) -> str``,
which raises ValueError.  Strings are described once each, in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACYCLIC = "<acyclic>"
HINT = "Molecular checks and scaffold splits need RDKit: pip install rdkit"


class RdkitBackend:
    def __init__(self):
        try:
            import rdkit.Chem  # noqa: F401
        except ImportError as e:
            raise ValueError(HINT) from e

    def _molecule(self, smiles: str):
        from rdkit import Chem

        mol = Chem.MolFromSmiles(smiles)
        if mol is None or not mol.GetNumAtoms():
            raise ValueError(f"Invalid SMILES {smiles!r}")
        if len(Chem.GetMolFrags(mol)) > 1:
            raise ValueError(f"Disconnected SMILES {smiles!r}; standardise salts and mixtures first")
        return mol

    def describe(self, smiles: str):
        from rdkit import Chem
        from rdkit.Chem import rdFingerprintGenerator

        try:
            mol = self._molecule(smiles)
        except ValueError:
            return None
        bits = rdFingerprintGenerator.GetMorganGenerator(radius=2, fpSize=2048, includeChirality=True).GetFingerprint(mol)
        words = [0] * 32
        for at in bits.GetOnBits():
            words[at // 64] |= 1 << (at % 64)
        return Chem.MolToSmiles(mol), [w - (1 << 64) if w >> 63 else w for w in words]

    def scaffold(self, smiles: str) -> str:
        from rdkit.Chem.Scaffolds import MurckoScaffold

        return MurckoScaffold.MurckoScaffoldSmiles(mol=self._molecule(smiles), includeChirality=False) or ACYCLIC


backend_factory = RdkitBackend


def describe(smiles: DataFrame) -> DataFrame:
    """``(smiles, identity, fp)`` for each distinct string of the one column; nulls in the last two where it is no molecule."""
    backend = backend_factory()
    shape = T.StructType().add("smiles", "string").add("identity", "string").add("fp", T.ArrayType(T.LongType()))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [backend.describe(s) or (None, None) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], names=shape.names)

    return smiles.toDF("smiles").where(F.col("smiles").isNotNull()).distinct().mapInArrow(run, shape)


def scaffolds(smiles: DataFrame) -> DataFrame:
    """``(smiles, scaffold, problem)`` for each distinct string of the one column."""
    backend = backend_factory()
    shape = T.StructType().add("smiles", "string").add("scaffold", "string").add("problem", "string")

    def one(s: str):
        try:
            return backend.scaffold(s), None
        except ValueError as e:
            return None, str(e)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [one(s) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], names=shape.names)

    return smiles.toDF("smiles").distinct().mapInArrow(run, shape)
