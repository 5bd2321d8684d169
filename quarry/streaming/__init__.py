"""Incremental forms of batch operators; an extension, as corpora are built in batch."""
