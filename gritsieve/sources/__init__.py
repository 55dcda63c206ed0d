"""Readers and writers: recordings, version-control logs, recorded web responses, exports, configuration."""
