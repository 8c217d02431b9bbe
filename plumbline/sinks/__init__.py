"""Writers for point clouds, models and documents."""
