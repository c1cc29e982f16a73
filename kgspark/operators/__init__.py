"""Set-at-a-time operators over the triple table."""
