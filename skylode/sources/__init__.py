"""Readers and writers: typed text tables, label files, archives, JSON lines, guarded outputs."""
