"""DataFrame operators that find, mask, restore and audit sensitive values."""
