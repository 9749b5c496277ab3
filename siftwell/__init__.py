"""Company and contact qualification as DataFrame transforms."""
