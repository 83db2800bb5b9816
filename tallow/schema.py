"""Sizes and value ranges of the data model (fixed values: the stored formats depend on them)."""

GROUP = 512  # elements that share a centre
LANE = 16  # consecutive elements of a group that share a bit stream
LANES = GROUP // LANE
RADIX = 126  # residual steps per signal unit
BLOCK = 4096  # bytes per entropy-coded block
STATES = 32  # interleaved coder states per block
STATE_BITS = 31
STATE_MIN = 1 << 15
MAGIC = 0xD00D0001
HEADER_BYTES = 32
PROB_BITS = (9, 10, 11)
ESCAPE = 254
PAD = 255
PAD_TO = 8
#: Longest unary signal before the byte form writes a literal, by element width in bytes.
LITERAL_LIMIT = {2: 4, 4: 8}


def check_prob_bits(bits: int) -> int:
    if bits not in PROB_BITS:
        raise ValueError(f"probability precision must be one of {PROB_BITS}, not {bits}")
    return bits
