"""From a parsed query to typed patterns."""
