"""Compress and decompress, as functions and as a command."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from helixmill.operators.qvz import read_matrix
from helixmill.sources import archive, fastq


def quality_mode(words: list[str]) -> tuple:
    """Check and convert the words of the quality option."""
    kind, rest = words[0], words[1:]
    if kind in ("lossless", "ill_bin") and not rest:
        return (kind,)
    if kind == "qvz" and rest:
        if not float(rest[0]) > 0:
            raise ValueError("the qvz ratio must be above 0")
        return (kind, float(rest[0]), *map(qvz_option, rest[1:]))
    if kind == "binary" and len(rest) == 3:
        at, high, low = map(int, rest)
        if not low <= at <= high:
            raise ValueError("binary quality needs low <= threshold <= high")
        return (kind, at, high, low)
    raise ValueError(f"invalid quality mode: {' '.join(words)}")


def qvz_option(word: str) -> tuple[str, object]:
    """``fixed`` (bits instead of a ratio), ``d=M|L|A`` (squared, Lorentz, absolute cost), ``D=file`` (a matrix of costs),
    ``c=20,30`` (codebooks of their own between these mean qualities), ``seed=n``."""
    name, _, value = word.partition("=")
    if word == "fixed":
        return ("fixed", True)
    if name == "d" and value in ("M", "L", "A"):
        return ("kind", {"M": "mse", "L": "lorentz", "A": "l1"}[value])
    if name == "D" and value:
        return ("kind", read_matrix(value))
    if name == "c" and value:
        return ("clusters", tuple(sorted(float(x) for x in value.split(","))))
    if name == "seed" and value:
        return ("seed", int(value))
    raise ValueError(f"invalid qvz option: {word}")


def compress(spark: SparkSession, inputs: list[str], output: str, allow_reorder: bool = False, no_quality: bool = False, no_ids: bool = False, quality: tuple = ("lossless",), long_mode: bool = False, fasta: bool = False) -> archive.Params:
    """FASTQ or FASTA, one file or two of mates, plain or gzip by name, into an archive folder."""
    if not 1 <= len(inputs) <= 2:
        raise ValueError("one or two input files")
    no_quality = no_quality or fasta
    reads = fastq.scan_paired(spark, *inputs, fasta=fasta) if len(inputs) == 2 else fastq.scan(spark, inputs[0], fasta)
    return archive.write_archive(reads, output, len(inputs) == 2, long_mode, not allow_reorder, not no_quality, not no_ids, quality)


def decompress(spark: SparkSession, path: str, outputs: list[str] | None = None, first: int | None = None, last: int | None = None, gzip: bool = False, level: int = 6) -> DataFrame:
    """Reads of an archive; written as FASTQ (FASTA if it has no qualities) where outputs are named.

    A paired archive with one output name writes ``<name>.1`` and ``<name>.2``; a single one uses the first name.
    """
    p = archive.read_params(spark, path)
    reads = archive.read_archive(spark, path, first, last)
    if outputs:
        if p.paired:
            names = outputs if len(outputs) == 2 else [f"{outputs[0]}.1", f"{outputs[0]}.2"]
            for m, name in enumerate(names, 1):
                fastq.write(reads.where(reads["mate"] == m), name, p.quality, gzip, level)
        else:
            fastq.write(reads, outputs[0], p.quality, gzip, level)
    return reads


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="helixmill", description="Columnar archive of sequencing reads.")
    way = a.add_mutually_exclusive_group(required=True)
    way.add_argument("-c", "--compress", action="store_true")
    way.add_argument("-d", "--decompress", action="store_true")
    a.add_argument("--decompress-range", nargs=2, type=int, metavar=("START", "END"))
    a.add_argument("-i", "--input-file", nargs="+", required=True)
    a.add_argument("-o", "--output-file", nargs="+", required=True)
    a.add_argument("-w", "--working-dir", help="shared folder for intermediate data")
    a.add_argument("-t", "--num-threads", type=int, default=8)
    a.add_argument("-r", "--allow-read-reordering", action="store_true")
    a.add_argument("--no-quality", action="store_true")
    a.add_argument("--no-ids", action="store_true")
    a.add_argument("-q", "--quality-opts", nargs="+", default=["lossless"])
    a.add_argument("-l", "--long", action="store_true")
    a.add_argument("-g", "--gzipped-fastq", action="store_true")
    a.add_argument("--gzip-level", type=int, default=6, choices=range(10))
    a.add_argument("--fasta-input", action="store_true")
    return a


def main(argv: list[str] | None = None) -> int:
    from helixmill.session import get_session

    a = parser().parse_args(argv)
    if a.compress and len(a.output_file) != 1:
        raise ValueError("one output")
    mode = quality_mode(a.quality_opts)
    spark = get_session(str(a.num_threads))
    if a.working_dir:
        spark.sparkContext.setCheckpointDir(a.working_dir)
    if a.compress:
        compress(spark, a.input_file, a.output_file[0], a.allow_read_reordering, a.no_quality, a.no_ids, mode, a.long, a.fasta_input)
    else:
        decompress(spark, a.input_file[0], a.output_file, *(a.decompress_range or (None, None)), gzip=a.gzipped_fastq, level=a.gzip_level)
    return 0


if __name__ == "__main__":
    sys.exit(main())
