"""Training-data operators for very large text collections; nothing outside this subpackage imports it."""
