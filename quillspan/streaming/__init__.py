"""Streams: the search has no stateful stream operator; new collection files are taken up as they come."""
