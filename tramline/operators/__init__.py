"""DataFrame -> DataFrame operators on feed tables and catalogue tables."""
