"""Small fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# State code and region.
STATES = [
    ("am", "norte"), ("ap", "norte"), ("ac", "norte"), ("rr", "norte"), ("ro", "norte"), ("to", "norte"),
    ("PA", "norte"), ("SP", "sudeste"), ("MG", "sudeste"), ("RJ", "sudeste"), ("ES", "sudeste"), ("PR", "sul"),
    ("SC", "sul"), ("RS", "sul"), ("MS", "centro-oeste"), ("MT", "centro-oeste"), ("GO", "centro-oeste"),
    ("DF", "centro-oeste"), ("BA", "nordeste"), ("AL", "nordeste"), ("SE", "nordeste"), ("PE", "nordeste"),
    ("PB", "nordeste"), ("RN", "nordeste"), ("CE", "nordeste"), ("MA", "nordeste"),
]

# Correlation of five distance measures.
MEASURES = ["Jaccard", "Cosseno", "Cosseno-PCA", "Keselj", "Stamatatos"]
MEASURE_CORRELATION = [
    [1.00, -0.76, -0.41, 0.97, 0.68],
    [-0.76, 1.00, 0.76, -0.84, -0.52],
    [-0.41, 0.76, 1.00, -0.55, -0.15],
    [0.97, -0.84, -0.55, 1.00, 0.65],
    [0.68, -0.52, -0.15, 0.65, 1.00],
]

# The twelve note names of an octave.
NOTE_NAMES = ["C", "C_S_", "D", "D_S_", "E", "F", "F_S_", "G", "G_S_", "A", "A_S_", "B"]


def note_frequencies(octaves: int = 9) -> list[tuple[int, str, float]]:
    """(position, name, hertz) in equal temperament: A4 is 440, a half tone is the 12th root of 2."""
    return [(12 * o + i, f"{name}{o}", round(440.0 * 2.0 ** ((12 * o + i - 57) / 12), 6))
            for o in range(octaves) for i, name in enumerate(NOTE_NAMES)]


def states(spark: SparkSession) -> DataFrame:
    rows = [(i, s, r) for i, (s, r) in enumerate(STATES)]
    return spark.createDataFrame(rows, "position int, state string, region string")


def notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(note_frequencies(), "position int, name string, freq double")


def measure_correlation(spark: SparkSession) -> DataFrame:
    rows = [(a, b, MEASURE_CORRELATION[i][j]) for i, a in enumerate(MEASURES) for j, b in enumerate(MEASURES)]
    return spark.createDataFrame(rows, "a string, b string, r double")
