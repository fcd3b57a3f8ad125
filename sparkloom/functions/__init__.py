"""Column builders for paths, contents, transcripts and attestations, and text operators that need Python."""
