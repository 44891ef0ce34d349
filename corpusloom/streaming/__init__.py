"""Streams. Normalisation, coding and id mapping are stateless per row, so they take streams as they are; this module names
the two jobs that a stream is used for."""
