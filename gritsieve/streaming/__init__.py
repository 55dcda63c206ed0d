"""Incremental state: watermarks, evaluated keys, the ledger and its streaming form."""
