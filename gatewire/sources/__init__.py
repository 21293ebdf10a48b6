"""Where messages come from and where events, lookup tables and the partition list are kept."""
