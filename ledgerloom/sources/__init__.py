"""Reading delimited files under a declared contract."""
