"""Tables that keep their history, and files in buckets."""

from .files import Bucket, File
from .sequences import Sequence
from .store import Conflict, Store, Table, Transaction, Work

__all__ = ["Bucket", "Conflict", "File", "Sequence", "Store", "Table", "Transaction", "Work"]
