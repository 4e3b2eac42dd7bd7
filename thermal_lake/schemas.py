"""Column layouts of the stored tables; readers use these instead of inferring."""

from __future__ import annotations

FIELD = ("modelo string, dataset string, point_id long, x float, y float, z float, "
         "t_idx int, t_min double, t_c float")
SNAPSHOT_STATS = ("modelo string, dataset string, t_idx int, t_min double, solnum int, t_min_c double, "
                  "t_max_c double, n_total long, n_filtered long, n_carbon long")
PROBE = ("modelo string, dataset string, probe string, coord_mm struct<x:double,y:double,z:double>, "
         "coord_real struct<x:double,y:double,z:double>, snapped boolean, in_domain boolean, min_dist_mm double")
PROBE_SERIES = "modelo string, dataset string, probe string, t_min double, t_c double, t_c_original double"
EXPERIMENT = "exp_id string, probe_idx int, label string, t_min double, t_c double"
CATALOG = ("ruta string, fuente string, modelo string, dataset string, partition_key string, "
           "tipo string, antena string, num_antenas double, caso double, potencia_w double, "
           "dataset_corregido boolean, tag_correccion string, seq long")
CATALOG_ALIAS = "partition_key string, alias string, seq long"
CORRECTION_ZONE = ("corr_id string, zone_id int, z_min double, z_max double, top boolean, t_origin double, "
                   "offset_c double, exp_max double")
KNOT = "corr_id string, zone_id int, t double, f double"
SOLUTION = ("modelo string, tag_std string, tag_sol string, tag_dset string, idx_caso int, p_ant int, "
            "p_tot double, estado string, t_sim_min double")
VOXEL = ("dist_id string, ix int, iy int, iz int, x double, y double, z double, occ boolean, sdf double")
FACET = ("mesh_id string, facet_id long, v1 struct<x:double,y:double,z:double>, "
         "v2 struct<x:double,y:double,z:double>, v3 struct<x:double,y:double,z:double>")
PIXEL = "image_id string, row int, col int, r double, g double, b double"
SLICE = "image_id string, pos int, face int, thickness double"
RUN = ("run_id long, ts timestamp, best_fitness double, total_s double, imported boolean")
SSA = ("corr_id string, zone_id int, method string, t_start double, f_start double, step double, mean double, "
       "window int, rank int, coef array<double>, history array<double>, max_step double, low double, high double")

# Storage layout of the archive and the four acquisition columns of corrected data.
PARTITIONS = ("tipo", "antena", "caso", "potencia_w")
ACQUISITION_PARTITIONS = ("fecha", "tiempo", "prueba", "zonas")
