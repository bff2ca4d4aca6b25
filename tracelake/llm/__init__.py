"""Operations for preparing training corpora: filters, near-duplicate detection, packing, mixing, scoring and archives."""
