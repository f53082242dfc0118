"""Named query plans over the driver's tables."""
