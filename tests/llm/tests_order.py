"""Row order of the operators, for the brute-force versions."""

import xxhash


def order(rows):
    def key(row):
        h = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
        return row[0] is None, row[0] or 0, h - (1 << 64) if h >> 63 else h

    return sorted(rows, key=key)
