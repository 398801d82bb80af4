"""Broadcasting behind a check of the size."""

from tesselle.session import bounded, broadcast_if_small  # noqa: F401
