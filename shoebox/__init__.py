"""Shoebox: a catalogue engine for media libraries on Spark."""
