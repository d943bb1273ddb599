"""Imports every module that registers queries."""

from viatrix.plans import appraisal_plans, file_plans, network_plans, raster_plans, report_plans, relational_plans, route_plans, spatial_plans, track_plans  # noqa: F401
