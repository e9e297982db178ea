"""The configuration of an index, checked when it is made."""

from __future__ import annotations

from dataclasses import dataclass

DEFAULT_BITS = 5
MAX_WORKING_DIM_FIELD = 65_535


@dataclass(frozen=True)
class IndexConfig:
    """dim: length of the vectors; working_dim: leading coordinates that are used; seed: of the sign stream."""

    dim: int
    seed: int = 42
    working_dim: int | None = None
    bits: int = DEFAULT_BITS
    residual: bool = False

    def __post_init__(self) -> None:
        if self.working_dim is None:
            object.__setattr__(self, "working_dim", self.dim)
        if self.dim < 1 or not 1 <= self.working_dim <= self.dim:
            raise ValueError(f"working_dim must lie between 1 and dim, not {self.working_dim} of {self.dim}")
        if self.working_dim != self.dim and self.working_dim > MAX_WORKING_DIM_FIELD:
            raise ValueError(f"a working_dim below dim must be at most {MAX_WORKING_DIM_FIELD}")
        if self.bits not in (4, 5, 6):
            raise ValueError(f"bits must be 4, 5 or 6, not {self.bits}")
        if self.residual and self.bits != 4:
            raise ValueError("a residual pass needs 4 bits")
        if self.residual and self.working_dim != self.dim:
            raise ValueError("a residual pass needs the full dimension")
        if not 0 <= self.seed < 1 << 64:
            raise ValueError("seed must be an unsigned 64-bit number")

    @property
    def padded(self) -> int:
        return 1 << (self.working_dim - 1).bit_length()

    @property
    def code_bytes(self) -> int:
        """Bytes of one packed code row."""
        return -(-self.padded * self.bits // 8)

    @property
    def bytes_per_vector(self) -> int:
        """Codes and half-precision scales, both passes."""
        return (self.code_bytes + 2) * (2 if self.residual else 1)
