"""Training-data operators: tokenizers, near-copy joins, decontamination, search, scans."""
