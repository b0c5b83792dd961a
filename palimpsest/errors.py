"""What can go wrong in a store."""


class StoreError(Exception):
    """Base of all errors raised by this package."""


class Corruption(StoreError):
    """Stored data contradicts itself."""


class InvalidArgument(StoreError):
    """A request that can never succeed."""


class Poisoned(StoreError):
    """An earlier log write failed; the store only reads until it is opened again."""


class Conflict(StoreError):
    """A key the transaction depends on changed after its snapshot."""


class ProtocolError(StoreError):
    """A malformed request on the wire."""
