"""Readers: media files, transcription results, log lines."""
