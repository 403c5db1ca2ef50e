"""catalog subpackage."""
