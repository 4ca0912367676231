"""readmill: redundancy filtering, k-mer counting, taxonomic classification and accuracy benchmarking of sequence reads on Spark."""

__version__ = "0.1.0"
