"""Relational, segment, track, sequence and skeleton operators."""
