"""Generation of pairs by a pluggable backend, in bounded rounds."""
